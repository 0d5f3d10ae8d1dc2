"""Dataset specifications: YAML files, column catalogues, validation."""

from __future__ import annotations

import csv
import datetime as dt
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from loomery.functions import providers

# Column types and output formats.
COLUMN_TYPES = ("sequence", "constant", "code_set", "numeric_range", "date_range", "faker", "passthrough", "needs_mapping")
OUTPUT_FORMATS = ("csv", "parquet")


class SchemaError(ValueError):
    """A specification that can't be used."""


@dataclass
class ColumnSpec:
    name: str
    type: str
    missing_pct: float = 0.0
    unique: bool = False
    dtype: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> ColumnSpec:
        if "name" not in raw or "type" not in raw:
            raise SchemaError(f"a column needs a name and a type: {raw}")
        rest = {k: v for k, v in raw.items() if k not in ("name", "type", "missing_pct", "unique", "dtype")}
        return cls(str(raw["name"]), str(raw["type"]), float(raw.get("missing_pct") or 0), bool(raw.get("unique", False)), raw.get("dtype"), rest)

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"name": self.name, "type": self.type}
        if self.dtype:
            out["dtype"] = self.dtype
        out |= self.params
        if self.missing_pct:
            out["missing_pct"] = self.missing_pct
        if self.unique:
            out["unique"] = True
        return out


@dataclass
class DatasetSpec:
    rows: int = 1000
    seed: int | None = None
    locale: str = "en_US"
    formats: list[str] = field(default_factory=lambda: ["csv"])
    output_dir: str = "data"
    file_stem: str = "synthetic"
    reference: str | None = None
    columns: list[ColumnSpec] = field(default_factory=list)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> DatasetSpec:
        top = raw.get("dataset") or {}
        spec = cls(columns=[ColumnSpec.from_dict(c) for c in raw.get("columns") or []])
        for key in ("seed", "locale", "output_dir", "file_stem", "reference"):
            if top.get(key) is not None:
                setattr(spec, key, top[key])
        spec.rows = int(top.get("rows", spec.rows))
        spec.formats = list(top.get("formats") or spec.formats)
        return spec

    def to_dict(self) -> dict[str, Any]:
        top: dict[str, Any] = {"rows": self.rows}
        if self.seed is not None:
            top["seed"] = self.seed
        if self.locale != "en_US":
            top["locale"] = self.locale
        top |= {"formats": self.formats, "output_dir": self.output_dir, "file_stem": self.file_stem}
        if self.reference:
            top["reference"] = self.reference
        return {"dataset": top, "columns": [c.to_dict() for c in self.columns]}


def load_schema(path: str | Path) -> DatasetSpec:
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not raw:
        raise SchemaError(f"{path} is empty")
    return DatasetSpec.from_dict(raw)


def dump_schema(spec: DatasetSpec) -> str:
    return yaml.safe_dump(spec.to_dict(), sort_keys=False, allow_unicode=True)


def _number(x: Any) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _day(x: Any) -> dt.date | None:
    try:
        return dt.date.fromisoformat(str(x))
    except ValueError:
        return None


def _check_column(c: ColumnSpec, reference: str | None) -> list[str]:
    p, found = c.params, []
    if c.type not in COLUMN_TYPES:
        return [f"{c.name}: unknown type {c.type!r}"]
    if not 0 <= c.missing_pct <= 100:
        found.append(f"{c.name}: missing_pct must be from 0 to 100")
    if c.type == "needs_mapping":
        found.append(f"{c.name}: needs_mapping has to be replaced by a type")
    elif c.type == "constant" and "value" not in p:
        found.append(f"{c.name}: constant needs a value")
    elif c.type == "code_set":
        values, weights = p.get("values"), p.get("weights")
        if not values and not p.get("values_file"):
            found.append(f"{c.name}: code_set needs values or values_file")
        if weights is not None and any(_number(w) is None or _number(w) < 0 for w in weights):
            found.append(f"{c.name}: weights must be numbers of 0 or more")
        elif weights is not None and values and len(weights) != len(values):
            found.append(f"{c.name}: as many weights as values are needed")
    elif c.type == "numeric_range":
        low, high = _number(p.get("min")), _number(p.get("max"))
        if low is None or high is None:
            found.append(f"{c.name}: numeric_range needs numbers as min and max")
        elif low > high:
            found.append(f"{c.name}: min is greater than max")
    elif c.type == "date_range":
        first, last = _day(p.get("start")), _day(p.get("end"))
        if first is None or last is None:
            found.append(f"{c.name}: date_range needs start and end as YYYY-MM-DD")
        elif first > last:
            found.append(f"{c.name}: start is after end")
    elif c.type == "faker":
        if not p.get("provider"):
            found.append(f"{c.name}: faker needs a provider")
        elif not providers.is_known(p["provider"]):
            found.append(f"{c.name}: unknown provider {p['provider']!r}")
    elif c.type == "passthrough":
        if not p.get("source_column"):
            found.append(f"{c.name}: passthrough needs a source_column")
        if not reference:
            found.append(f"{c.name}: passthrough needs a reference")
    return found


def validate_schema(spec: DatasetSpec, reference: str | None = None) -> list[str]:
    """What is wrong with a specification; empty if nothing is. reference: one that is given apart from it."""
    found = [] if spec.rows > 0 else ["rows must be greater than 0"]
    found += [f"unknown format {f!r}" for f in spec.formats if f not in OUTPUT_FORMATS]
    if not spec.columns:
        found.append("there are no columns")
    names = [c.name for c in spec.columns]
    found += [f"column {n!r} is there twice" for n in dict.fromkeys(names) if names.count(n) > 1]
    return found + [x for c in spec.columns for x in _check_column(c, reference or spec.reference)]


# ---- column catalogues

_NUMERIC = ("min", "max", "step")


def _exact(x: str) -> int | float | str:
    n = _number(x)
    return x if n is None else int(n) if n.is_integer() and "e" not in x.lower() else n


def _column_of(row: dict[str, str]) -> ColumnSpec:
    cell = {k.strip(): v.strip() for k, v in row.items() if k and v and v.strip()}
    if "name" not in cell or "type" not in cell:
        raise SchemaError(f"a catalogue row needs a name and a type: {row}")
    params: dict[str, Any] = {}
    for key, x in cell.items():
        if key in ("name", "type", "missing_pct", "unique", "dtype"):
            continue
        if key == "kwargs_json":
            try:
                params["kwargs"] = json.loads(x)
            except json.JSONDecodeError as e:
                raise SchemaError(f"{cell['name']}: kwargs_json: {e}") from e
        elif key in ("values", "weights"):
            params[key] = [float(p) if key == "weights" else p.strip() for p in x.split("|")]
        elif key in ("start", "start_seq"):
            if cell["type"] == "sequence":
                params["start"] = _exact(x)
            elif key == "start":
                params["start"] = x
        else:
            params[key] = _exact(x) if key in _NUMERIC else x
    return ColumnSpec(cell["name"], cell["type"], float(cell.get("missing_pct", 0)), cell.get("unique", "").lower() in ("true", "1", "yes"), cell.get("dtype"), params)


def csv_to_yaml(csv_path: str | Path, out_path: str | Path | None = None, **dataset: Any) -> DatasetSpec:
    """A specification from a catalogue with a row for each column; written as YAML if ``out_path`` is given."""
    with open(csv_path, newline="", encoding="utf-8-sig") as file:
        columns = [_column_of(r) for r in csv.DictReader(file) if any((v or "").strip() for v in r.values() if isinstance(v, str))]
    if not columns:
        raise SchemaError(f"{csv_path} has no columns")
    spec = DatasetSpec(columns=columns, **{k: v for k, v in dataset.items() if v is not None})
    if out_path:
        Path(out_path).write_text(dump_schema(spec), encoding="utf-8")
    return spec
