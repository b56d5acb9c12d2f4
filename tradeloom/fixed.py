"""Fixed values.

Names, lookup tables, patterns, thresholds and message texts that outputs must
carry unchanged so that results agree with the system this engine replaces.
They are plain data; no logic lives here.
"""

from __future__ import annotations

# --- JSON-LD -----------------------------------------------------------------
VOCABULARY_CONTEXT = "https://ref.gs1.org/voc/data/gs1Voc.jsonld"
SCHEMA_CONTEXT_JSON = '{"schema":"https://schema.org/"}'
DIGITAL_LINK_PREFIX = "https://id.gs1.org/01/"
PRODUCT_TYPE = "gs1:Product"
VOCABULARY_IRI = "https://gs1.org/voc/"
SCHEMA_IRI = "https://schema.org/"

# --- Leftover report ---------------------------------------------------------
STRUCTURAL_ELEMENTS = (
    "catalogueItemNotificationMessage",
    "transaction",
    "transactionIdentification",
    "catalogueItem",
    "tradeItem",
    "tradeItemInformation",
    "tradeItemDescriptionInformation",
    "tradeItemMeasurements",
    "marketingInformation",
    "brandNameInformation",
    "informationProviderOfTradeItem",
    "contentOwner",
    "referencedFileInformation",
    "quantityContained",
    "nutrientDetail",
    "allergen",
)
FILE_CONTEXT_PARENT = "referencedFileInformation"
FILE_CONTEXT_FIELDS = (
    "fileFormatName",
    "fileName",
    "referencedFileTypeCode",
    "uniformResourceIdentifier",
)
DISCRIMINATORS = {
    "nutrientDetail": "nutrientTypeCode",
    "allergen": "allergenTypeCode",
    "certification": "certificationIdentification",
}

# --- Archive limits ----------------------------------------------------------
MAX_FILES = 100
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_TOTAL_BYTES = 100 * 1024 * 1024

# --- Token matching ----------------------------------------------------------
STOPWORDS = (
    "a", "an", "the", "of", "in", "for", "to", "and", "or", "is", "are",
    "be", "with", "that", "this", "as", "at", "by", "has", "have", "it",
    "its", "not", "on", "from", "which", "when", "where", "type", "code",
    "value", "number", "name", "data", "item", "product", "gdsn", "gs1",
    "urn", "gdd", "bie",
)

# --- Candidate scoring -------------------------------------------------------
CANDIDATE_VERSION = "v0.11.0"
SIGNALS = {
    "existing_mapping_catalog_match": 0.90,
    "mapping_yaml_canonical_field_match": 0.65,
    "semantic_resource_urn_match": 0.80,
    "exact_property_name_match": 0.70,
    "label_attribute_token_overlap": 0.35,
    "xpath_terminal_match": 0.25,
    "definition_comment_overlap": 0.20,
    "range_datatype_compatible": 0.15,
    "quantity_uom_compatible": 0.20,
    "code_list_signal": 0.15,
    "standards_review_linked": 0.10,
}
PENALTIES = {
    "deleted_attribute_warning": -0.30,
    "datatype_mismatch_warning": -0.15,
    "class_row_not_attribute": -0.20,
}
BLOCKING_NOTES = {
    "deleted_attribute_warning": (
        "GDSN attribute is marked deleted; not recommended for new mappings."
    ),
    "datatype_mismatch_warning": (
        "Range/DataType mismatch detected; semantic review required."
    ),
    "class_row_not_attribute": "Row is Class/Module type, not a leaf Attribute.",
}
BAND_HIGH, BAND_MEDIUM, BAND_LOW = 0.70, 0.40, 0.15
CATALOG_SIGNAL_STATUSES = (
    "mapped_official_bms_xpath", "candidate_official_bms_xpath", "candidate", "mapped",
)
ALREADY_MAPPED_STATUSES = (
    "mapped_official_bms_xpath", "candidate_official_bms_xpath", "mapped",
)
BEST_ROW_STATUSES = ("mapped_official_bms_xpath", "mapped")
CONFIDENCE_LEVELS = ("high", "medium", "low", "review_required")
REVIEW_STATUSES = ("proposed", "already_mapped", "review_required", "not_recommended")
QUANTITY_RANGES = (
    "gs1:quantitativevalue", "gs1:measurementtype", "gs1:measurement",
)
COMPATIBLE_TYPES = {
    "xsd:string": (
        "string", "description200", "description40", "string40", "string80",
        "string200", "string500", "string5000", "formatteddescription5000",
        "partneridentification", "gln", "gtin", "string1..80",
        "alphanumerictext5000",
    ),
    "rdf:langstring": (
        "string", "description200", "description40", "formatteddescription5000",
        "languagespecificstring40", "languagespecificstring200",
        "languagespecificstring5000", "description",
    ),
    "xsd:boolean": ("boolean",),
    "xsd:decimal": ("decimal", "measurement", "numeric"),
    "xsd:integer": ("integer", "count"),
    "xsd:float": ("float", "decimal", "measurement"),
    "xsd:double": ("float", "decimal", "double"),
    "xsd:date": ("date", "datetime"),
    "xsd:datetime": ("datetime", "date"),
    "xsd:anyuri": ("string", "anyuri", "url"),
    "gs1:quantitativevalue": ("measurement", "decimal", "float"),
}
INCOMPATIBLE_TYPES = {
    "xsd:boolean": (
        "string", "description200", "description40", "measurement",
        "decimal", "gtin", "gln",
    ),
    "xsd:integer": ("boolean", "string"),
    "xsd:date": ("boolean", "string", "gtin"),
    "rdf:langstring": ("boolean", "integer", "decimal"),
}

# --- Mapping catalog ---------------------------------------------------------
CATALOG_COLUMNS = (
    "mapping_version", "scope_group", "gdsn_bms_id", "gdsn_attribute_name",
    "gdsn_xpath", "gdsn_module", "gdsn_datatype", "gdsn_cardinality", "code_list",
    "canonical_field", "jsonld_property", "jsonld_structure", "jsonld_object_type",
    "technical_mapping_file", "mapping_status", "confidence", "notes", "source",
    "webvoc_property_status", "webvoc_property_validation",
    "recommended_jsonld_property", "review_action",
)
CATALOG_STATUSES = (
    "mapped", "mapped_official_bms_xpath", "mapped_needs_bms_review",
    "candidate", "candidate_needs_code_filter_review",
    "candidate_official_bms_xpath", "candidate_needs_webvoc_review",
    "needs_bms_review", "needs_semantic_review", "needs_web_vocab_review",
    "needs_webvoc_review", "unsupported", "out_of_scope", "experimental",
    "review_replace", "model_review",
)
CATALOG_CONFIDENCES = ("high", "medium", "low")
MAPPED_ROW_REQUIRED = (
    "gdsn_attribute_name", "gdsn_xpath", "canonical_field", "technical_mapping_file",
)

# --- Vocabulary explorer -----------------------------------------------------
COVERAGE_STATUSES = (
    "mapped", "high_confidence", "candidate", "experimental",
    "standards_review_required", "schema_org_fallback", "unmapped", "unknown",
)
# From weakest to strongest when several catalog rows speak for one property.
COVERAGE_PRIORITY = (
    "unmapped", "unknown", "mapped", "high_confidence", "candidate",
    "experimental", "schema_org_fallback", "standards_review_required",
)
TOPIC_GROUPS = (
    ("Nutritional Information", ("nutrient", "nutrition", "calorie", "energy")),
    ("Allergens", ("allergen", "allergy", "containment")),
    ("Certifications", ("certification", "certificate", "certified", "accreditation")),
    ("Documents and DPP", ("document", "referencedfile", "file type", "dpp", "passport")),
    ("Food, Beverage & Tobacco", ("food", "beverage", "tobacco", "ingredient", "diet")),
    ("Physical Dimensions", ("dimension", "height", "width", "depth", "weight",
                             "measurement", "netcontent")),
    ("Packaging Details", ("packag", "case", "pallet", "container", "label")),
    ("Organization and Place", ("organization", "organisation", "place", "location",
                                "address", "contact")),
    ("Offer and Sales Information", ("offer", "price", "sales", "sell", "order",
                                     "payment", "invoice")),
    ("Traceability and Lifecycle", ("trace", "lifecycle", "life cycle", "batch", "lot",
                                    "serial", "expiry", "production")),
    ("Provenance and Claims", ("claim", "provenance", "organic", "halal", "kosher",
                               "sustainab")),
    ("Digital Links & Services", ("linktype", "digital link", "url", "website", "service")),
    ("Classification & Links", ("classification", "category", "gpc", "code", "sameas")),
    ("Core Product Information", ("gtin", "product", "brand", "description", "name")),
)
LINK_TOPIC = "Digital Links & Services"
OTHER_TOPIC = "Other Web Vocabulary Properties"
# Order in which the summary lists the groups.
TOPIC_SUMMARY_ORDER = (
    "Core Product Information", "Classification & Links", "Physical Dimensions",
    "Digital Links & Services", "Provenance and Claims", "Packaging Details",
    "Food, Beverage & Tobacco", "Nutritional Information", "Allergens",
    "Certifications", "Documents and DPP", "Organization and Place",
    "Offer and Sales Information", "Traceability and Lifecycle",
    "Other Web Vocabulary Properties",
)
CLASS_TYPES = ("owl:Class", "rdfs:Class")
PROPERTY_TYPES = ("rdf:Property", "owl:ObjectProperty", "owl:DatatypeProperty")

# --- Source attribute reference data -----------------------------------------
ATTRIBUTE_HEADERS = {
    "bmsid": "bms_id", "message": "message", "sunrise": "sunrise",
    "sunset": "sunset", "changetype": "change_type", "xpath": "xpath",
    "module": "module", "type": "row_type", "parentclass": "parent_class",
    "name": "attribute_name", "multiplicity": "multiplicity", "length": "length",
    "datatype": "data_type", "namedassociation": "named_association",
    "classassociatedto": "class_associated_to",
    "codelistenumeration": "code_list_enumeration",
    "codelistname": "code_list_name", "bmscodelistid": "bms_code_list_id",
    "languageenabled": "language_enabled", "uomenabled": "uom_enabled",
    "currencyenabled": "currency_enabled", "globallocal": "global_local",
    "semanticresourceurn": "semantic_resource_urn", "definition": "definition",
}
ATTRIBUTE_LINEAGE = ("source_sheet", "source_version", "is_deleted", "is_candidate_source")
DELETED_SHEET = "Deleted Attributes"
VOCABULARY_PROPERTY_FIELDS = (
    "term_id", "compact_name", "label", "comment", "domain", "range",
    "sub_property_of", "type", "is_link_type", "term_status", "version",
    "last_modified",
)
VOCABULARY_CLASS_FIELDS = (
    "term_id", "compact_name", "label", "comment", "sub_class_of", "type",
    "term_status", "version", "last_modified",
)
MANIFEST_REQUIRED = (
    "source_id", "title", "source_url", "retrieved_at", "version", "local_path",
    "sha256", "public_accessible", "authoritative_or_derived", "used_by",
    "license_or_rights_note", "usage_note",
)

# --- Decision backlog --------------------------------------------------------
BACKLOG_CSV_COLUMNS = (
    "id", "title", "status", "category", "warning_count", "blocks_release",
    "standards_review_required", "recommended_owner", "target_release",
    "decision_file", "issue_number", "issue_url",
)

# --- Product passport --------------------------------------------------------
PASSPORT_ID_PREFIX = "urn:gdsn-gs1-jsonld:product-passport:"
PASSPORT_TYPE = "product-passport-prototype"
PASSPORT_VERSION = "v0.13.0-prototype"
PASSPORT_BUILDER = "v0.13.0"
PASSPORT_STATUS = "prototype"
PASSPORT_MODE = "minimal-schema-prototype"
PASSPORT_SCHEMA = "dpp_minimal.schema.json"
PASSPORT_NOTICE = (
    "Prototype/reference Product Passport JSON-LD generated for standards "
    "discussion only. Structural schema validation only. Not official GS1 "
    "validation, not EU DPP regulatory compliance, and not production-ready."
)
PASSPORT_VALIDATION_NOTE = (
    "Structural validation result is provided separately in the "
    "validation report. Passing means only that the JSON matches "
    "the selected local structural schema."
)
FALLBACK_WARNING = (
    "FALLBACK MODE: jsonschema is not installed, so only required-field "
    "presence was checked — this is weaker than full Draft7 validation. "
    "A 'valid' result here does not mean the document passed structural "
    "schema validation. Install jsonschema for full Draft7 validation."
)
INVENTORY_VERSION = "v0.12.0"
PLACEHOLDER_SHA256 = "PLACEHOLDER_SHA256_AFTER_DOWNLOAD"
PASSPORT_SOURCE_TYPES = ("context", "epcis_example", "example", "json_schema", "shacl_shape")
PASSPORT_SECTORS = ("battery", "core", "epcis", "general_product", "textile")
PASSPORT_SOURCE_REQUIRED = (
    "local_path", "sector", "source_id", "source_type", "source_url", "title",
)
INVENTORY_CSV_COLUMNS = (
    "source_id", "title", "source_type", "sector", "version", "local_path",
    "_file_exists", "_checksum_status", "_actual_sha256",
)

# --- Authoring ---------------------------------------------------------------
AUTHORING_NOTICE = (
    "Manual JSON-LD prototype. This output is entered manually, not generated "
    "from GDSN XML. It is not BMS/XPath traceable unless linked to governed "
    "mapping evidence. It is not an official GS1 validation result."
)
QUANTITY_WORDS = ("content", "weight", "height", "width", "depth", "dimension")

# Descriptions in the mapping report, by field or object of the built-in profiles.
DESCRIPTIONS = {
    "gtin": "Global Trade Item Number",
    "product_name": "Multilingual product name",
    "product_description": "Multilingual short product description",
    "brand_name": "Product brand name",
    "gpc_category_code": "GS1 Global Product Classification category code",
    "net_content_value": "Numeric net content value",
    "net_content_unit": "Net content measurement unit code",
    "product_image_url": "Product image URL",
    "product_page_url": "Product marketing page URL",
    "ingredient_statement": "Multilingual ingredient statement",
    "allergens": "Allergen details",
    "nutrients": "Basic nutrient details",
    "certifications": "BMS-aligned certification details",
    "referenced_documents": "DPP-like and certification document references",
}
