"""Mapping profiles: declarative rules from XML elements to product properties.

A profile is small driver-side configuration. Its element paths are limited to
the shapes profiles use (descendant, child, nearest ancestor, attribute and code
conditions); anything else is refused when the profile is loaded.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml

from tradeloom.fixed import DESCRIPTIONS, SCHEMA_CONTEXT_JSON, VOCABULARY_CONTEXT


class ProfileError(ValueError):
    """The profile cannot be read or uses an unsupported path."""


# --- Element paths -------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """``attribute`` present, or a ``child``/``descendant`` holding one of ``codes``."""

    kind: str
    name: str
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    name: str
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class ElementPath:
    """``anchor``: ``anywhere`` below the root, ``below`` the current element, or
    below its nearest ancestor called ``ancestor``."""

    anchor: str
    steps: tuple[Step, ...]
    ancestor: str | None = None


_NAMED = r"\*\[local-name\(\)='([^']+)'\]"
_CODE = r"normalize-space\(text\(\)\)='([^']*)'"
_STEP = re.compile(rf"{_NAMED}((?:\[(?:[^\[\]]|\[[^\[\]]*(?:\[[^\[\]]*\])?[^\[\]]*\])*\])*)")
_ATTRIBUTE = re.compile(r"\[@([\w.-]+)\]")
_JOINED_CODE = re.compile(
    rf"\[\.(//?)\*\[local-name\(\)='([^']+)' and {_CODE}\]\]"
)
_NESTED_CODES = re.compile(
    rf"\[\.(//?){_NAMED}\[({_CODE}(?: or {_CODE})*)\]\]"
)
_ANCESTOR = re.compile(rf"ancestor::{_NAMED}\[1\]/")


def _conditions(text: str, path: str) -> tuple[Condition, ...]:
    found = []
    while text:
        if match := _ATTRIBUTE.match(text):
            found.append(Condition("attribute", match[1]))
        elif match := _JOINED_CODE.match(text):
            kind = "descendant" if match[1] == "//" else "child"
            found.append(Condition(kind, match[2], (match[3],)))
        elif match := _NESTED_CODES.match(text):
            kind = "descendant" if match[1] == "//" else "child"
            codes = tuple(re.findall(_CODE, match[3]))
            found.append(Condition(kind, match[2], codes))
        else:
            raise ProfileError(f"Unsupported condition in path: {path}")
        text = text[match.end():]
    return tuple(found)


def read_path(path: str) -> ElementPath:
    """Recognise one of the supported element-path shapes."""
    ancestor = None
    if path.startswith(".//"):
        anchor, rest = "anywhere", path[3:]
    elif path.startswith("./"):
        anchor, rest = "below", path[2:]
    elif match := _ANCESTOR.match(path):
        anchor, ancestor, rest = "ancestor", match[1], path[match.end():]
    else:
        raise ProfileError(f"Unsupported path: {path}")
    steps = []
    while True:
        match = _STEP.match(rest)
        if not match:
            raise ProfileError(f"Unsupported path: {path}")
        steps.append(Step(match[1], _conditions(match[2], path)))
        rest = rest[match.end():]
        if not rest:
            return ElementPath(anchor, tuple(steps), ancestor)
        if not rest.startswith("/") or rest.startswith("//"):
            raise ProfileError(f"Unsupported path: {path}")
        rest = rest[1:]


def read_value_path(path: str) -> tuple[str, str]:
    """``('text', '')``, ``('content', '')`` or ``('attribute', name)``."""
    if path in ("text()", "./text()"):
        return "text", ""
    if path == ".":
        return "content", ""
    if match := re.fullmatch(r"(?:\./)?@([\w.:-]+)", path):
        return "attribute", match[1]
    raise ProfileError(f"Unsupported value path: {path}")


# --- Rules -----------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    id: str
    xpath: str
    jsonld_property: str
    canonical_field: str | None = None
    description: str = ""
    value_xpath: str = "text()"
    language_xpath: str | None = None
    required: bool = False
    datatype: str = "string"
    multiple: bool = False
    fallback_language: str | None = None
    transform: tuple[str, ...] = ()

    @property
    def path(self) -> ElementPath:
        return read_path(self.xpath)


@dataclass(frozen=True)
class ObjectRule:
    id: str
    description: str
    parent_xpath: str
    canonical_field: str
    jsonld_property: str
    fields: tuple[Rule, ...]
    object_type: str | None = None
    multiple: bool = True

    @property
    def path(self) -> ElementPath:
        return read_path(self.parent_xpath)


@dataclass(frozen=True)
class Profile:
    fields: tuple[Rule, ...]
    objects: tuple[ObjectRule, ...] = ()
    default_language: str = "en"
    context: tuple[Any, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)
    file_name: str = ""


def _take(data: dict[str, Any], cls: type, required: tuple[str, ...], where: str) -> dict:
    if not isinstance(data, dict):
        raise ProfileError(f"{where} must be an object.")
    missing = [key for key in required if data.get(key) is None]
    if missing:
        raise ProfileError(f"{where} lacks: {', '.join(missing)}")
    known = cls.__dataclass_fields__
    return {key: value for key, value in data.items() if key in known and value is not None}


def _rule(data: dict[str, Any], *, nested: bool) -> Rule:
    required = ("id", "xpath", "jsonld_property")
    if not nested:
        required += ("description", "canonical_field")
    values = _take(data, Rule, required, f"Field {data.get('id', '?')}")
    values["transform"] = tuple(values.get("transform", ()))
    rule = Rule(**values)
    anchors = ("below", "ancestor") if nested else ("anywhere",)
    if rule.path.anchor not in anchors:
        raise ProfileError(f"Field {rule.id}: path cannot start there: {rule.xpath}")
    read_value_path(rule.value_xpath)
    if rule.language_xpath and read_value_path(rule.language_xpath)[0] != "attribute":
        raise ProfileError(f"Field {rule.id}: language must come from an attribute.")
    return rule


def profile_from_dict(data: Any, file_name: str = "") -> Profile:
    if not isinstance(data, dict):
        raise ProfileError(f"Mapping file must contain a YAML object: {file_name}")
    for key in ("settings", "fields"):
        if key not in data:
            raise ProfileError(f"Mapping file lacks '{key}': {file_name}")
    settings = data["settings"] or {}
    objects = []
    for item in data.get("object_mappings") or ():
        values = _take(
            item,
            ObjectRule,
            ("id", "description", "parent_xpath", "canonical_field", "jsonld_property", "fields"),
            f"Object {item.get('id', '?')}",
        )
        values["fields"] = tuple(_rule(f, nested=True) for f in item["fields"])
        rule = ObjectRule(**values)
        if rule.path.anchor != "anywhere":
            raise ProfileError(f"Object {rule.id}: path cannot start there.")
        objects.append(rule)
    return Profile(
        fields=tuple(_rule(f, nested=False) for f in data["fields"]),
        objects=tuple(objects),
        default_language=settings.get("default_language", "en"),
        context=tuple(settings.get("jsonld_context") or ()),
        metadata=data.get("metadata") or {},
        file_name=file_name,
    )


def load_profile(path: str | Path) -> Profile:
    """Read a profile from a YAML file on the driver."""
    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(f"Mapping file not found: {file}")
    try:
        data = yaml.safe_load(file.read_text(encoding="utf-8"))
    except yaml.YAMLError as exc:
        raise ProfileError(str(exc)) from exc
    return profile_from_dict(data, file.name)


def mapping_records(profile: Profile) -> list[dict[str, str]]:
    """Flatten to comparable records: fields, object parents, object fields."""
    rows = [
        _record(r.id, "field", r.canonical_field, r.jsonld_property, r.xpath)
        for r in profile.fields
    ]
    for parent in profile.objects:
        stem = f"{parent.canonical_field}[]"
        rows.append(
            _record(parent.id, "object", stem, parent.jsonld_property, parent.parent_xpath)
        )
        rows += [
            _record(
                r.id, "object_field", f"{stem}.{r.canonical_field or r.id}",
                r.jsonld_property, r.xpath,
            )
            for r in parent.fields
        ]
    return [{**row, "mapping_file": profile.file_name} for row in rows]


def _record(id_: str, kind: str, canonical: str, prop: str, xpath: str) -> dict[str, str]:
    return {
        "id": id_, "kind": kind, "canonical_field": canonical,
        "jsonld_property": prop, "xpath": xpath,
    }


# --- Built-in profiles -----------------------------------------------------------


def _el(*names: str) -> str:
    return "/".join(f"*[local-name()='{n}']" for n in names)


def _field(name: str, path: str, prop: str, *steps: str, **extra: Any) -> Rule:
    return Rule(
        id=name, canonical_field=name, description=DESCRIPTIONS[name],
        xpath=".//" + path, jsonld_property=prop, transform=("trim", *steps), **extra,
    )


def _child(name: str, path: str, canonical: str, prop: str, *steps: str, **extra: Any) -> Rule:
    return Rule(
        id=name, xpath=path if path.startswith("ancestor") else "./" + path,
        canonical_field=canonical, jsonld_property=prop, transform=("trim", *steps), **extra,
    )


_LANGUAGE = {
    "datatype": "language_string", "multiple": True, "fallback_language": "en",
    "language_xpath": "./@languageCode",
}
_FILE = "referencedFileInformation"
_IMAGE_TEST = (
    "[.//*[local-name()='referencedFileTypeCode' and "
    "normalize-space(text())='PRODUCT_IMAGE']]/"
)
_DOCUMENT_TEST = (
    "[./*[local-name()='referencedFileTypeCode']"
    "[normalize-space(text())='DPP_DOCUMENT' or "
    "normalize-space(text())='CERTIFICATION_DOCUMENT']]"
)


def _ancestor(name: str, child: str) -> str:
    return f"ancestor::{_el(name)}[1]/{_el(child)}"


def _basic_fields() -> tuple[Rule, ...]:
    # Element names, canonical fields and target properties.
    ws = "normalize_whitespace"
    return (
        _field("gtin", _el("gtin"), "gs1:gtin", "validate_gtin", required=True),
        _field("product_name", _el("tradeItemDescription"), "gs1:productName", ws,
               required=True, **_LANGUAGE),
        _field("product_description", _el("descriptionShort"), "gs1:productDescription",
               ws, **_LANGUAGE),
        _field("brand_name", _el("brandName"), "gs1:brandName"),
        _field("gpc_category_code", _el("gpcCategoryCode"), "gs1:gpcCategoryCode"),
        _field("net_content_value", _el("netContent", "measurementValue"),
               "gs1:netContent", "to_decimal", datatype="decimal"),
        _field("net_content_unit", _el("netContent", "measurementUnitCode"),
               "gs1:netContent", "uppercase"),
        _field("product_image_url",
               _el(_FILE) + _IMAGE_TEST + _el("uniformResourceIdentifier"),
               "gs1:productImage", "validate_url", datatype="url", multiple=True),
        _field("product_page_url", _el("marketingInformation", "uniformResourceIdentifier"),
               "schema:url", "validate_url", datatype="url"),
    )


def _food_objects() -> tuple[ObjectRule, ...]:
    up = "uppercase"
    return (
        ObjectRule(
            "allergens", DESCRIPTIONS["allergens"], ".//" + _el("allergenRelatedInformation", "allergen"),
            "allergens", "gs1:hasAllergen",
            (
                _child("allergen_type", _el("allergenTypeCode"), "allergen_type",
                       "gs1:allergenType", up, required=True),
                _child("level_of_containment", _el("levelOfContainmentCode"),
                       "level_of_containment", "gs1:levelOfContainment", up, required=True),
            ),
            object_type="gs1:AllergenDetails",
        ),
        ObjectRule(
            "nutrients", DESCRIPTIONS["nutrients"], ".//" + _el("nutrientHeader", "nutrientDetail"),
            "nutrients", "gs1:nutrientDetail",
            (
                _child("preparation_state_code",
                       _ancestor("nutrientHeader", "preparationStateCode"),
                       "preparation_state_code", "gs1:preparationStateCode", up),
                _child("nutrient_type_code", _el("nutrientTypeCode"),
                       "nutrient_type_code", "gs1:nutrientTypeCode", up, required=True),
                _child("quantity_value", _el("quantityContained", "measurementValue"),
                       "quantity_contained.value", "gs1:quantityContained.value",
                       "to_decimal", required=True, datatype="decimal"),
                _child("quantity_unit", _el("quantityContained", "measurementUnitCode"),
                       "quantity_contained.unit_code", "gs1:quantityContained.unitCode",
                       up, required=True),
            ),
        ),
    )


def _certificate_objects() -> tuple[ObjectRule, ...]:
    ws, info = "normalize_whitespace", "certificationInformation"
    return (
        ObjectRule(
            "certifications", DESCRIPTIONS["certifications"], ".//" + _el(info, "certification"),
            "certifications", "gs1:certification",
            (
                _child("certification_standard", _ancestor(info, "certificationStandard"),
                       "certification_standard", "gs1:certificationStandard", ws),
                _child("certification_identification", _el("certificationIdentification"),
                       "certification_identification", "schema:identifier"),
                _child("certification_value", _el("certificationValue"),
                       "certification_value", "gs1:certificationValue", ws, required=True),
                _child("certificate_issuance_date_time", _el("certificateIssuanceDateTime"),
                       "certificate_issuance_date_time", "schema:dateIssued"),
                _child("certification_assessment_date_time",
                       _el("certificationAssessmentDateTime"),
                       "assessment_date", "gs1:certificationAuditDate", "to_date"),
                _child("certification_effective_start_date_time",
                       _el("certificationEffectiveStartDateTime"),
                       "effective_start", "gs1:certificationStartDate", "to_date"),
                _child("certification_effective_end_date_time",
                       _el("certificationEffectiveEndDateTime"),
                       "effective_end", "gs1:certificationEndDate", "to_date"),
                _child("certification_organisation_identifier",
                       _ancestor(info, "certificationOrganisationIdentifier"),
                       "certification_organisation_identifier", "gs1:certificationAgency"),
            ),
            object_type="gs1:CertificationDetails",
        ),
        ObjectRule(
            "referenced_documents", DESCRIPTIONS["referenced_documents"],
            ".//" + _el(_FILE) + _DOCUMENT_TEST,
            "referenced_documents", "gs1:referencedDocument",
            (
                _child("document_file_name", _el("fileName"), "file_name", "schema:name"),
                _child("document_file_format", _el("fileFormatName"), "file_format",
                       "schema:encodingFormat", "uppercase"),
                _child("document_file_type", _el("referencedFileTypeCode"),
                       "referenced_file_type", "schema:additionalType", "uppercase",
                       required=True),
                _child("document_url", _el("uniformResourceIdentifier"), "document_url",
                       "schema:url", "validate_url", required=True, datatype="url"),
            ),
            object_type="schema:DigitalDocument",
        ),
    )


def built_in_profile(level: str = "full") -> Profile:
    """``basic`` (9 fields), ``food`` (10 and 2 objects) or ``full`` (10 and 4)."""
    base = Profile(
        fields=_basic_fields(),
        context=(VOCABULARY_CONTEXT, json.loads(SCHEMA_CONTEXT_JSON)),
        file_name="mapping_mvp.yaml",
    )
    if level == "basic":
        return base
    ingredients = _field(
        "ingredient_statement", _el("ingredientStatement") + "[@languageCode]",
        "gs1:ingredientStatement", "normalize_whitespace", **_LANGUAGE,
    )
    food = replace(
        base, fields=(*base.fields, ingredients), objects=_food_objects(),
        file_name="mapping_v0_2.yaml",
    )
    if level == "food":
        return food
    if level == "full":
        return replace(
            food, objects=(*food.objects, *_certificate_objects()),
            file_name="mapping_v0_3.yaml",
        )
    raise ProfileError(f"Unknown built-in profile: {level}")
