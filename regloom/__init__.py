"""Register-machine programs as Spark data: generate, run, render, check, compare and measure them at scale."""

from .functions.tokens import decode, encode, render_cot, render_direct, render_probe, render_userops
from .operators.asm import parse, render
from .operators.check import validate
from .operators.expand import expand
from .operators.vm import run
from .sources.bundles import checked, judged
from .sources.datasets import VERSION, all_splits, emit, from_json, load, load_manifest, load_prompts, packed, rows, schema, to_json, to_parquet, verify
from .sources.digest import blocks, digests
from .sources.scan import first_rows, numbered
from .sources.specs import RECIPES, Recipe

__version__ = VERSION
__all__ = [
    "RECIPES", "Recipe", "all_splits", "blocks", "checked", "decode", "digests", "emit", "encode", "expand", "first_rows", "from_json", "judged", "load", "load_manifest",
    "load_prompts", "numbered", "packed", "parse", "render", "render_cot", "render_direct", "render_probe", "render_userops", "rows", "run", "schema", "to_json", "to_parquet", "validate", "verify",
]
