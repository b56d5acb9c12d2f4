"""Our own sample messages and what converting them must give."""

from __future__ import annotations

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def wrap(item: str, prefix: str = "g") -> bytes:
    """A message around trade-item content; ``~`` stands for the prefix."""
    root = "catalogueItemNotificationMessage"
    text = (
        f'{_HEAD}<~:{root} xmlns:~="urn:test:a" xmlns:s="urn:test:b"><~:transaction>'
        "<~:transactionIdentification><s:entityIdentification>T-1</s:entityIdentification>"
        "</~:transactionIdentification>"
        f"<~:catalogueItem><~:tradeItem>{item}</~:tradeItem></~:catalogueItem>"
        f"</~:transaction></~:{root}>"
    )
    return text.replace("~", prefix).encode()


FULL = wrap(
    """
  <~:gtin>04012345678901</~:gtin>
  <~:brandNameInformation><~:brandName> Nordlicht </~:brandName></~:brandNameInformation>
  <~:gpcCategoryCode>10001234</~:gpcCategoryCode>
  <~:tradeItemDescriptionInformation>
    <~:tradeItemDescription languageCode="de">Hafer
        Riegel</~:tradeItemDescription>
    <~:tradeItemDescription languageCode="en">Oat "bar" \\ 40 g</~:tradeItemDescription>
    <~:tradeItemDescription languageCode="en">Oat "bar" \\ 40 g</~:tradeItemDescription>
    <~:descriptionShort>Crunchy</~:descriptionShort>
  </~:tradeItemDescriptionInformation>
  <~:tradeItemMeasurements><~:netContent>
    <s:measurementValue>40.50</s:measurementValue>
    <s:measurementUnitCode>grm</s:measurementUnitCode>
  </~:netContent></~:tradeItemMeasurements>
  <~:tradeItemInformation>
    <~:marketingInformation>
      <~:uniformResourceIdentifier>https://example.org/p/1</~:uniformResourceIdentifier>
    </~:marketingInformation>
    <~:referencedFileInformation>
      <~:fileName>front.png</~:fileName>
      <~:referencedFileTypeCode> PRODUCT_IMAGE </~:referencedFileTypeCode>
      <~:uniformResourceIdentifier>https://example.org/i/front.png</~:uniformResourceIdentifier>
    </~:referencedFileInformation>
    <~:referencedFileInformation>
      <~:fileName>passport.pdf</~:fileName>
      <~:fileFormatName>pdf</~:fileFormatName>
      <~:referencedFileTypeCode>DPP_DOCUMENT</~:referencedFileTypeCode>
      <~:uniformResourceIdentifier>https://example.org/d/passport.pdf</~:uniformResourceIdentifier>
    </~:referencedFileInformation>
  </~:tradeItemInformation>
  <~:ingredientStatement>
    <~:ingredientStatement languageCode="de">Hafer, Salz.</~:ingredientStatement>
  </~:ingredientStatement>
  <~:allergenRelatedInformation>
    <~:allergen><~:allergenTypeCode>aw</~:allergenTypeCode>
      <~:levelOfContainmentCode>Contains</~:levelOfContainmentCode></~:allergen>
    <~:allergen><~:allergenTypeCode>AW</~:allergenTypeCode>
      <~:levelOfContainmentCode>CONTAINS</~:levelOfContainmentCode></~:allergen>
  </~:allergenRelatedInformation>
  <~:nutrientHeader>
    <~:preparationStateCode>Unprepared</~:preparationStateCode>
    <~:nutrientDetail><~:nutrientTypeCode>FAT</~:nutrientTypeCode><~:quantityContained>
      <s:measurementValue>1</s:measurementValue>
      <s:measurementUnitCode>GRM</s:measurementUnitCode></~:quantityContained></~:nutrientDetail>
    <~:nutrientDetail><~:nutrientTypeCode>FAT</~:nutrientTypeCode><~:quantityContained>
      <s:measurementValue>1.0</s:measurementValue>
      <s:measurementUnitCode>GRM</s:measurementUnitCode></~:quantityContained></~:nutrientDetail>
  </~:nutrientHeader>
  <~:certificationInformation>
    <~:certificationStandard>Eco  Standard</~:certificationStandard>
    <~:certification>
      <~:certificationValue>C-9</~:certificationValue>
      <~:certificationEffectiveStartDateTime>2025-03-01T00:00:00Z</~:certificationEffectiveStartDateTime>
    </~:certification>
  </~:certificationInformation>
"""
)

FULL_JSONLD = {
    "@context": ["https://ref.gs1.org/voc/data/gs1Voc.jsonld", {"schema": "https://schema.org/"}],
    "@type": "gs1:Product",
    "@id": "https://id.gs1.org/01/04012345678901",
    "gs1:gtin": "04012345678901",
    "gs1:productName": [
        {"@value": "Hafer Riegel", "@language": "de"},
        {"@value": 'Oat "bar" \\ 40 g', "@language": "en"},
    ],
    "gs1:productDescription": [{"@value": "Crunchy", "@language": "en"}],
    "gs1:brandName": "Nordlicht",
    "gs1:gpcCategoryCode": "10001234",
    "gs1:productImage": ["https://example.org/i/front.png"],
    "schema:url": "https://example.org/p/1",
    "gs1:ingredientStatement": [{"@value": "Hafer, Salz.", "@language": "de"}],
    "gs1:netContent": {"value": 40.5, "unitCode": "GRM"},
    "gs1:hasAllergen": [
        {"@type": "gs1:AllergenDetails", "gs1:allergenType": "AW",
         "gs1:levelOfContainment": "CONTAINS"}
    ],
    "gs1:nutrientDetail": [
        {"gs1:preparationStateCode": "UNPREPARED", "gs1:nutrientTypeCode": "FAT",
         "gs1:quantityContained": {"value": 1, "unitCode": "GRM"}}
    ],
    "gs1:certification": [
        {"@type": "gs1:CertificationDetails", "gs1:certificationStandard": "Eco Standard",
         "gs1:certificationValue": "C-9", "gs1:certificationStartDate": "2025-03-01"}
    ],
    "gs1:referencedDocument": [
        {"@type": "schema:DigitalDocument", "schema:name": "passport.pdf",
         "schema:encodingFormat": "PDF", "schema:additionalType": "DPP_DOCUMENT",
         "schema:url": "https://example.org/d/passport.pdf"}
    ],
}

FAULTY = wrap(
    """
  <~:gtin>123</~:gtin>
  <~:tradeItemDescriptionInformation>
    <~:tradeItemDescription languageCode="en"> </~:tradeItemDescription>
    <~:storage languageCode="nl"><~:hint>dry</~:hint></~:storage>
  </~:tradeItemDescriptionInformation>
  <~:netContent><s:measurementValue>much</s:measurementValue>
    <s:measurementUnitCode>GRM</s:measurementUnitCode></~:netContent>
  <~:referencedFileInformation>
    <~:referencedFileTypeCode>PRODUCT_IMAGE</~:referencedFileTypeCode>
    <~:uniformResourceIdentifier>https://ok.example/x</~:uniformResourceIdentifier>
    <~:uniformResourceIdentifier>nowhere</~:uniformResourceIdentifier>
  </~:referencedFileInformation>
  <~:nutrientHeader><~:nutrientDetail>
    <~:nutrientTypeCode>FAT</~:nutrientTypeCode><~:source>lab</~:source>
  </~:nutrientDetail></~:nutrientHeader>
""",
    prefix="other",
)
