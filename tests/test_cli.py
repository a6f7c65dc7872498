"""Public names and the command line."""

import glob
import json
import os

import regloom
from regloom.__main__ import main


def test_public_names():
    assert all(hasattr(regloom, n) for n in regloom.__all__) and regloom.__version__


def test_emit_and_verify(spark, tmp_path, capsys):
    out = f"file://{tmp_path}"
    assert main(["emit", "--tier", "tier9", "--out", out]) == 2 and "tier9" in capsys.readouterr().err
    assert main(["verify", "--dataset", f"{out}/tier0"]) == 2  # no manifest
    assert main(["emit", "--tier", "tier0", "--out", out, "--rows", "6", "--seed", "3", "--mode", "counter"]) == 0
    told = json.load(open(f"{tmp_path}/tier0/manifest.json"))
    assert told["seed_base"] == 3 and sum(f["rows"] for f in told["files"].values()) == 12
    assert main(["verify", "--dataset", f"{out}/tier0"]) == 0
    part = sorted(glob.glob(f"{tmp_path}/tier0/train.jsonl/part-*"))[0]
    os.remove(part)
    assert main(["verify", "--dataset", f"{out}/tier0"]) == 2 and "missing" in capsys.readouterr().err
