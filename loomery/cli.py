"""Command line: init, infer, csv-to-yaml, validate, generate, synth."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from loomery.plans.spec import OUTPUT_FORMATS, ColumnSpec, DatasetSpec, SchemaError, csv_to_yaml, dump_schema, load_schema, validate_schema

# Names of delimiters.
DELIMITERS = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def example() -> DatasetSpec:
    """A small specification to start from."""
    column = lambda name, kind, missing=0.0, **params: ColumnSpec(name, kind, missing, params=params)
    return DatasetSpec(seed=1, columns=[
        column("order_id", "sequence", start=1000, step=1),
        column("buyer", "faker", provider="name"),
        column("contact", "faker", provider="email"),
        column("items", "numeric_range", min=1, max=12),
        column("channel", "code_set", values=["web", "shop", "phone"], weights=[0.6, 0.3, 0.1]),
        column("ordered_on", "date_range", start="2024-01-01", end="2024-12-31"),
        column("currency", "constant", value="CAD"),
        column("remark", "faker", 20.0, provider="sentence"),
    ])


def catalogue(spec: DatasetSpec) -> list[dict[str, str]]:
    """A specification as rows of a column catalogue."""
    rows = []
    for c in spec.columns:
        cells = {k: "|".join(map(str, v)) if isinstance(v, list) else json.dumps(v) if isinstance(v, dict) else str(v) for k, v in c.params.items()}
        if "kwargs" in cells:
            cells["kwargs_json"] = cells.pop("kwargs")
        rows.append({"name": c.name, "type": c.type} | cells | ({"missing_pct": str(c.missing_pct)} if c.missing_pct else {}))
    return rows


def _init(a: argparse.Namespace) -> int:
    spec = example()
    for path, write in ((Path(a.out), lambda p: p.write_text(dump_schema(spec), encoding="utf-8")), (Path(a.csv_out), lambda p: _write_catalogue(p, spec))):
        if path.exists() and not a.force:
            print(f"{path} is there already; --force replaces it")
        else:
            write(path)
            print(f"wrote {path}")
    return 0


def _write_catalogue(path: Path, spec: DatasetSpec) -> None:
    rows = catalogue(spec)
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.DictWriter(file, fieldnames=list(dict.fromkeys(k for r in rows for k in r)))
        out.writeheader()
        out.writerows(rows)


def _infer(a: argparse.Namespace) -> int:
    from loomery.plans.infer import infer_schema, write_inferred_schema

    found = infer_schema(a.source, a.columns, a.rows, a.row_offset, a.threshold, a.weighted)
    write_inferred_schema(found, a.out, a.source)
    print(f"wrote {a.out}: {len(found.spec.columns)} columns, {len(found.notes)} of which need a type")
    return 0


def _convert(a: argparse.Namespace) -> int:
    spec = csv_to_yaml(a.csv, a.out, rows=a.rows, seed=a.seed, formats=a.formats, output_dir=a.output_dir, file_stem=a.file_stem, reference=a.reference)
    print(f"wrote {a.out}: {len(spec.columns)} columns")
    return _complain(validate_schema(spec), fail=False)


def _complain(errors: list[str], fail: bool = True) -> int:
    for e in errors:
        print(f"  - {e}", file=sys.stderr)
    return int(fail and bool(errors))


def _validate(a: argparse.Namespace) -> int:
    spec = load_schema(a.schema)
    errors = validate_schema(spec)
    print(f"{a.schema}: {len(errors)} errors" if errors else f"{a.schema}: {len(spec.columns)} columns, {spec.rows} rows, no errors")
    return _complain(errors)


def _generate(a: argparse.Namespace) -> int:
    from loomery.plans.generate import generate_dataset

    spec = load_schema(a.schema)
    spec.formats = a.formats or spec.formats
    errors = validate_schema(spec, a.reference)
    if errors:
        return _complain(errors)
    done = generate_dataset(spec, a.out_dir, a.rows, a.reference, a.reference_limit, a.chunk_size)
    print(f"{done['rows']} rows in {done['elapsed']:.1f} s: {', '.join(map(str, done['files']))}")
    return 0


def _print_report(r, verbose: bool) -> None:
    print(f"{r.source}: {r.error or ('profiled' if r.dry_run else r.output)} ({r.file_format}; {r.rows_in} rows in, {r.rows_out} out, {r.elapsed:.1f} s)")
    for w in r.warnings:
        print(f"  ! {w}")
    for c in r.columns:
        print(f"  {c.name:24} {c.semantic:15} blank {c.null_pct:5.1f} %  junk {c.junk_pct:5.1f} %  shapes {c.shapes:4}  collisions {c.collisions}, unresolved {c.unresolved}" + (f"  [{c.reason}]" if verbose else ""))


def _synth(a: argparse.Namespace) -> int:
    from loomery.plans.twin import synthesize

    mode = {"auto": None, "on": True, "off": False}[a.large_file_mode]
    reports = synthesize(
        a.path, a.out_dir, prefix=a.prefix, recursive=a.recursive, rows=a.rows, percent=a.percent, seed=a.seed, locale=a.locale, k=a.k, category_threshold=a.category_threshold,
        strict=a.strict, sample_rows=a.sample_rows or None, overrides=a.overrides, dry_run=a.dry_run, encoding=a.encoding, delimiter=DELIMITERS.get(a.delimiter, a.delimiter),
        has_header=not a.no_header, large_file=mode,
    )
    for r in reports:
        _print_report(r, a.verbose)
    if not reports:
        print(f"no supported files in {a.path}")
    if a.report:
        Path(a.report).write_text(json.dumps([r.to_dict() for r in reports], indent=2), encoding="utf-8")
    return int(any(not r.ok for r in reports))


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="loomery", description=__doc__)
    commands = root.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text, description=text)
        p.set_defaults(run=run)
        return p

    p = command("init", _init, "write an example specification and catalogue")
    p.add_argument("--out", default="schema.yaml")
    p.add_argument("--csv-out", default="columns.csv")
    p.add_argument("--force", action="store_true")

    p = command("infer", _infer, "a specification from a slice of a real file")
    p.add_argument("--source", required=True)
    p.add_argument("--columns", nargs="+")
    p.add_argument("--rows", type=int, required=True)
    p.add_argument("--row-offset", type=int, default=0)
    p.add_argument("--threshold", type=int, default=50)
    p.add_argument("--weighted", action="store_true")
    p.add_argument("--out", default="schema.yaml")

    p = command("csv-to-yaml", _convert, "a specification from a column catalogue")
    p.add_argument("--csv", required=True)
    p.add_argument("--out", default="schema.yaml")
    p.add_argument("--rows", type=int, default=1000)
    p.add_argument("--seed", type=int)
    p.add_argument("--formats", nargs="+", default=["csv"], choices=OUTPUT_FORMATS)
    p.add_argument("--output-dir", default="data")
    p.add_argument("--file-stem", default="synthetic")
    p.add_argument("--reference")

    p = command("validate", _validate, "check a specification")
    p.add_argument("--schema", required=True)

    p = command("generate", _generate, "write the dataset of a specification")
    p.add_argument("--schema", required=True)
    p.add_argument("--rows", type=int)
    p.add_argument("--out-dir")
    p.add_argument("--formats", nargs="+", choices=OUTPUT_FORMATS)
    p.add_argument("--reference")
    p.add_argument("--reference-limit", type=int, default=200_000)
    p.add_argument("--chunk-size", type=int, default=50_000)

    p = command("synth", _synth, "write twins of real files")
    p.add_argument("path")
    p.add_argument("--out-dir")
    p.add_argument("--prefix", default="synth_")
    p.add_argument("--recursive", "-r", action="store_true")
    size = p.add_mutually_exclusive_group()
    size.add_argument("--rows", type=int)
    size.add_argument("--percent", type=float)
    p.add_argument("--seed", type=int)
    p.add_argument("--locale", default="en_CA")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--category-threshold", type=int, default=50)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--sample-rows", type=int, default=200_000, help="0: all")
    p.add_argument("--overrides")
    p.add_argument("--report")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--encoding")
    p.add_argument("--delimiter")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--large-file-mode", choices=["auto", "on", "off"], default="auto")
    return root


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    try:
        code = a.run(a)
    except (SchemaError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        code = 1
    if code:
        sys.exit(code)
