"""Provenance: roster and code hashes, run status, experiment plans."""

from __future__ import annotations

import hashlib
import json
import subprocess
from itertools import product

from pyspark.sql import DataFrame


def roster_hash(rows: DataFrame, order: list[str], most: int = 10_000) -> str:
    """SHA-256 of the ordered rows as canonical JSON; null stays null, all else is text. For small frozen rosters."""
    got = rows.orderBy(*order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a roster of more than {most} rows")
    body = [{c: None if r[c] is None else str(r[c]) for c in rows.columns} for r in got]
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def code_revision(root: str) -> dict:
    """HEAD, whether the tree is dirty, and a hash of what differs; blanks outside a repository."""

    def git(*args: str) -> str | None:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
        return got.stdout if got.returncode == 0 else None

    head, changes = git("rev-parse", "HEAD"), git("status", "--porcelain")
    if head is None:
        return {"revision": "", "dirty": None, "state": ""}
    state = hashlib.sha256((head + (git("diff", "HEAD") or "") + (changes or "")).encode()).hexdigest()
    return {"revision": head.strip(), "dirty": bool(changes), "state": state}


#: Exit codes of a stage by its status.
EXIT = {"completed": 0, "failed": 1, "inputs_missing": 2, "awaiting_human_validation": 3, "dependency_unavailable": 4}


def status_row(spark, stage: str, status: str, detail: str = "") -> DataFrame:
    if status not in EXIT:
        raise ValueError(f"unknown status {status}")
    return spark.createDataFrame([(stage, status, EXIT[status], detail)], "stage string, status string, exit_code int, detail string")


#: Designs and inputs of the text baselines; a repeat design runs three inputs for each of its repeats.
DESIGNS = ("standard", "publisher_disjoint", "domain_disjoint", "temporal", "sensitivity")
PLANS = (
    ("logistic_regression", "model_text"), ("linear_svm", "model_text"), ("majority", "model_text"), ("title_only_logistic", "title"),
    ("masked_logistic", "model_text_masked"), ("publisher_only_logistic", "publisher_token"), ("unit_only_logistic", "unit_token"), ("length_only_logistic", "length_token"),
)


def baseline_matrix(datasets: list[str], available: set[tuple[str, str]]) -> list[dict]:
    """Every (dataset, design, model, input) whose split exists, in order."""
    return [dict(dataset=d, split_name=s, model=m, text_column=c, experiment_id=f"{d}_{s}_{m}_{c}") for d, s, (m, c) in product(datasets, DESIGNS, PLANS) if (d, s) in available]


def encoder_plan(splits: list[tuple[str, str]], encoders: list[str], seeds: list[int]) -> list[dict]:
    """Runs of external encoders (trained elsewhere; their predictions are read as tables)."""
    return [dict(dataset=d, split_name=s, model=m, seed=x) for (d, s), m, x in product(splits, encoders, seeds)]
