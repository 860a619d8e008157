"""IFC4 text of a building document: entity rows, and the STEP file made of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich
from .config import Config

_SCHEMA = "scan_id int, entity long, ifc_class string, args string"


@dataclass(frozen=True)
class _Typed:
    """A value written with its type."""

    kind: str
    value: object


@dataclass
class Report:
    """What enrichment has added to a model."""

    elements_enriched: int = 0
    classification_refs_added: int = 0
    property_sets_added: int = 0
    quantity_sets_added: int = 0
    validation_warnings: list[str] = field(default_factory=list)


class _Model:
    def __init__(self):
        self.rows: list[tuple[int, str, str]] = []

    def add(self, kind: str, *args) -> str:
        self.rows.append((len(self.rows) + 1, kind, ",".join(map(self._text, args))))
        return f"#{len(self.rows)}"

    @staticmethod
    def _text(v) -> str:
        if isinstance(v, str):
            return v if v[:1] in "#.*$" else "'" + v.replace("'", "''") + "'"
        if v is None:
            return "$"
        if isinstance(v, _Typed):
            return f"{v.kind}({_Model._text(v.value)})"
        if isinstance(v, bool):
            return ".T." if v else ".F."
        if isinstance(v, (list, tuple)):
            return "(" + ",".join(map(_Model._text, v)) + ")"
        if isinstance(v, float):
            text = f"{v:.6g}"
            return text if "." in text or "e" in text else f"{text}."
        if isinstance(v, int):
            return str(v)
        raise TypeError(f"no IFC value: {v!r}")

    def point(self, *xyz) -> str:
        return self.add("IFCCARTESIANPOINT", [float(v) for v in xyz])

    def direction(self, *xyz) -> str:
        return self.add("IFCDIRECTION", [float(v) for v in xyz])

    def place(self, loc=(0, 0, 0), x=(1, 0, 0), within=None) -> str:
        axes = self.add("IFCAXIS2PLACEMENT3D", self.point(*loc), self.direction(0, 0, 1), self.direction(*x))
        return self.add("IFCLOCALPLACEMENT", within, axes)

    def extruded(self, body: str, profile: str, depth: float) -> str:
        at = self.add("IFCAXIS2PLACEMENT3D", self.point(0, 0, 0), None, None)
        solid = self.add("IFCEXTRUDEDAREASOLID", profile, at, self.direction(0, 0, 1), float(depth))
        return self.add("IFCPRODUCTDEFINITIONSHAPE", None, None, [self.add("IFCSHAPEREPRESENTATION", body, "Body", "SweptSolid", [solid])])

    def box(self, body: str, x: float, y: float, z: float, centre=(0.0, 0.0)) -> str:
        at = self.add("IFCAXIS2PLACEMENT2D", self.point(*centre), None)
        return self.extruded(body, self.add("IFCRECTANGLEPROFILEDEF", ".AREA.", None, at, float(x), float(y)), z)

    def prism(self, body: str, outline, z: float) -> str:
        points = [self.point(*p) for p in outline]
        line = self.add("IFCPOLYLINE", [*points, points[0]])
        return self.extruded(body, self.add("IFCARBITRARYCLOSEDPROFILEDEF", ".AREA.", None, line), z)


def _guid(kind: str, name: str) -> str:
    """A stable 22-character identifier."""
    import hashlib

    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"
    n, out = int(hashlib.md5(f"{kind}/{name}".encode()).hexdigest(), 16), ""
    for _ in range(22):
        n, k = divmod(n, 64)
        out = letters[k] + out
    return letters[ord(out[0]) % 4] + out[1:]


_QUANTITY = {"Length": "IFCQUANTITYLENGTH", "Width": "IFCQUANTITYLENGTH", "Height": "IFCQUANTITYLENGTH", "Perimeter": "IFCQUANTITYLENGTH", "Area": "IFCQUANTITYAREA", "Volume": "IFCQUANTITYVOLUME"}


def _typed(value) -> _Typed:
    if isinstance(value, bool):
        return _Typed("IFCBOOLEAN", value)
    return _Typed("IFCREAL", value) if isinstance(value, float) else _Typed("IFCLABEL", str(value))


def _enriched(m: _Model, products: list[tuple[str, str, str, dict]], config: Config) -> Report:
    """Adds to every product (class, name, reference, its record) what the settings ask for, and counts it.

    Properties are the defaults of the class and quantities follow from the record, as in `enrich`. The dictionary
    is the built-in table, so a class is referred to by its name.
    """
    report = Report()
    rooted = lambda kind, name, *args: m.add(kind, _guid(kind, name), None, name, None, *args)
    if config.bsdd_add_classifications and products:
        source = m.add("IFCCLASSIFICATION", None, None, None, "buildingSMART Data Dictionary (bSDD)", None, None, None)
    for ifc_class, name, ref, record in products:
        pset, qto = enrich.PROPERTY_SETS[ifc_class]
        report.elements_enriched += 1
        if config.bsdd_add_classifications:
            link = m.add("IFCCLASSIFICATIONREFERENCE", None, ifc_class, ifc_class, source, None, None)
            rooted("IFCRELASSOCIATESCLASSIFICATION", f"class-{name}", [ref], link)
            report.classification_refs_added += 1
        if config.bsdd_add_psets:
            values = [m.add("IFCPROPERTYSINGLEVALUE", k, None, _typed(v), None) for k, v in enrich.DEFAULTS[ifc_class].items()]
            rooted("IFCRELDEFINESBYPROPERTIES", f"pset-{name}", [ref], m.add("IFCPROPERTYSET", _guid(pset, name), None, pset, None, values))
            report.property_sets_added += 1
        numbers = enrich.quantities(ifc_class, record, config.ifc_slab_thickness)
        if config.bsdd_add_qtos and numbers:
            values = [m.add(next(kind for end, kind in _QUANTITY.items() if k.endswith(end)), k, None, None, float(v), None) for k, v in numbers.items()]
            rooted("IFCRELDEFINESBYPROPERTIES", f"qto-{name}", [ref], m.add("IFCELEMENTQUANTITY", _guid(qto, name), None, qto, None, None, values))
            report.quantity_sets_added += 1
        if config.bsdd_validate_geometry:
            report.validation_warnings += enrich.warnings_of(ifc_class, name, record)
    return report


def build(doc: dict, config: Config) -> list[tuple[int, str, str]]:
    """Entity rows of one document: project, site, building, storeys, walls with openings, doors and windows, spaces, slabs."""
    return build_with_report(doc, config)[0]


def build_with_report(doc: dict, config: Config) -> tuple[list[tuple[int, str, str]], Report]:
    """`build`, and what enrichment added; nothing if bsdd_enrich is off."""
    m, products = _Model(), []
    root = lambda kind, name, *args: m.add(kind, _guid(kind, name), None, name, None, *args)
    units = m.add("IFCUNITASSIGNMENT", [m.add("IFCSIUNIT", "*", ".LENGTHUNIT.", None, ".METRE."), m.add("IFCSIUNIT", "*", ".AREAUNIT.", None, ".SQUARE_METRE."), m.add("IFCSIUNIT", "*", ".VOLUMEUNIT.", None, ".CUBIC_METRE.")])
    body = m.add("IFCGEOMETRICREPRESENTATIONCONTEXT", "Body", "Model", 3, 1e-5, m.add("IFCAXIS2PLACEMENT3D", m.point(0, 0, 0), None, None), None)
    project = root("IFCPROJECT", doc["project"]["name"], None, None, None, [body], units)
    site_at = m.place()
    site = root("IFCSITE", "Site", None, site_at, None, None, ".ELEMENT.", None, None, None, None, None)
    house_at = m.place(within=site_at)
    house = root("IFCBUILDING", "Building", None, house_at, None, None, ".ELEMENT.", None, None, None)
    root("IFCRELAGGREGATES", "project", project, [site])
    root("IFCRELAGGREGATES", "site", site, [house])
    storeys, places, inside = {}, {}, {}
    for s in doc["storeys"]:
        places[s["id"]] = m.place((0, 0, s["elevation"]), within=house_at)
        storeys[s["id"]] = root("IFCBUILDINGSTOREY", s["name"], None, places[s["id"]], None, None, ".ELEMENT.", float(s["elevation"]))
        inside[s["id"]] = []
    root("IFCRELAGGREGATES", "building", house, list(storeys.values()))
    first = next(iter(storeys))
    hosts = {}
    for w in doc["walls"]:
        level = w["storey"] if w["storey"] in storeys else first
        (sx, sy), (ex, ey) = w["start"], w["end"]
        n = math.hypot(ex - sx, ey - sy)
        at = m.place((sx, sy, 0), ((ex - sx) / n, (ey - sy) / n, 0), places[level])
        ref = root("IFCWALL", f"Wall-{w['id']}", None, at, m.box(body, n, w["thickness"], w["height"], (n / 2, 0.0)), None, ".STANDARD.")
        hosts[w["id"]] = (ref, at, w, level)
        inside[level].append(ref)
        products.append(("IfcWall", f"Wall-{w['id']}", ref, w))
    for kind, rows in (("Door", doc["doors"]), ("Window", doc["windows"])):
        for d in rows or []:
            if d["wall"] not in hosts:
                continue
            ref, at, w, level = hosts[d["wall"]]
            hole_at = m.place((d["offset"] + d["width"] / 2, 0, d.get("sill") or 0), within=at)
            hole = root("IFCOPENINGELEMENT", f"Opening-{d['id']}", None, hole_at, m.box(body, d["width"], w["thickness"] * 2, d["height"]), None, ".OPENING.")
            root("IFCRELVOIDSELEMENT", f"void-{d['id']}", ref, hole)
            part = root(f"IFC{kind.upper()}", f"{kind}-{d['id']}", None, m.place(within=hole_at), m.box(body, d["width"], 0.05, d["height"]), None, float(d["height"]), float(d["width"]), f".{kind.upper()}.", None, None)
            root("IFCRELFILLSELEMENT", f"fill-{d['id']}", hole, part)
            inside[level].append(part)
            products.append((f"Ifc{kind}", f"{kind}-{d['id']}", part, d))
    spaces = {s: [] for s in storeys}
    for r in doc["rooms"] or []:
        level = r["storey"] if r["storey"] in storeys else first
        spaces[level].append(root("IFCSPACE", r["name"], None, m.place(within=places[level]), m.prism(body, r["boundary"], r["height"]), r["name"], ".ELEMENT.", ".INTERNAL.", None))
        products.append(("IfcSpace", f"Space-{r['id']}", spaces[level][-1], r))
        if config.ifc_add_floor_slabs:
            inside[level].append(root("IFCSLAB", f"Slab-{r['id']}", None, m.place((0, 0, -config.ifc_slab_thickness), within=places[level]), m.prism(body, r["boundary"], config.ifc_slab_thickness), None, ".FLOOR."))
            products.append(("IfcSlab", f"Slab-{r['id']}", inside[level][-1], r))
    for s, ref in storeys.items():
        if inside[s]:
            root("IFCRELCONTAINEDINSPATIALSTRUCTURE", f"in-{s}", inside[s], ref)
        if spaces[s]:
            root("IFCRELAGGREGATES", f"spaces-{s}", ref, spaces[s])
    report = _enriched(m, products, config) if config.bsdd_enrich else Report()
    return m.rows, report


def entities(documents: DataFrame, config: Config) -> DataFrame:
    """scan_id, entity, ifc_class, args of every scan's model; one document is one row, so one scan per call."""
    rows = documents.select("scan_id", F.to_json(F.struct("project", "storeys", "walls", "doors", "windows", "rooms")).alias("doc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            for scan, doc in zip(pdf["scan_id"], pdf["doc"], strict=True):
                yield pd.DataFrame([(scan, *r) for r in build(json.loads(doc), config)], columns=["scan_id", "entity", "ifc_class", "args"])

    return rows.mapInPandas(run, _SCHEMA)


def step_text(rows: list[tuple[int, str, str]], name: str = "model.ifc") -> str:
    """The file's text from the entity rows of one scan."""
    head = f"ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION(('ViewDefinition [CoordinationView]'),'2;1');\nFILE_NAME('{name}','',(''),(''),'','','');\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n"
    return head + "".join(f"#{n}={kind}({args});\n" for n, kind, args in sorted(rows)) + "ENDSEC;\nEND-ISO-10303-21;\n"
