"""Loomery: a Spark-native engine for generating, profiling and twinning tabular data."""

from loomery.plans.generate import generate_dataset
from loomery.plans.infer import infer_schema
from loomery.plans.spec import ColumnSpec, DatasetSpec, SchemaError, csv_to_yaml, load_schema, validate_schema
from loomery.plans.twin import LeakError, synthesize, synthesize_file

__version__ = "0.1.0"
__all__ = ["ColumnSpec", "DatasetSpec", "LeakError", "SchemaError", "csv_to_yaml", "generate_dataset", "infer_schema", "load_schema", "synthesize", "synthesize_file", "validate_schema"]
