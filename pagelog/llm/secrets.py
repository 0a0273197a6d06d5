"""Secret scan: all rules in one automaton, every byte of a text read once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelog.llm.automaton import Scanner
from pagelog.llm.common import map_batches, own_columns, texts_of


@dataclass(frozen=True)
class Rule:
    """A byte pattern and what a match must fulfil. A match that fails is dropped; it still takes its place."""

    kind: str
    pattern: str
    holds: Callable[[str], bool] | None = None


def _value_of_six(match: str) -> bool:
    value = re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)\Z", match)
    return bool(value) and len(value[1]) >= 6


def _at_least(n: int) -> Callable[[str], bool]:
    return lambda match: len(match) >= n


#: The base rules, in the order in which kinds are listed. A shorter run of hexadecimal digits than 24
#: never grows into one that holds, so its count is part of the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _value_of_six),
    Rule("access", r"AKIA[A-Z0-9]+", _at_least(20)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further well-known shapes of credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", _at_least(40)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", _at_least(15)),
    Rule("google", r"AIza[A-Za-z0-9_-]+", _at_least(39)),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", _at_least(24)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _at_least(40)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

SCHEMA = "doc_id long, kind array<string>, start array<int>, end array<int>"


class SecretScanner:
    """find() gives (kind, start, end) by start, then kind; in code points, the end exclusive."""

    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.rules = rules
        self.scanner = Scanner([r.pattern for r in rules])

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out = []
        for text, data, found in zip(texts, raw, self.scanner.find_all(raw), strict=True):
            kept = []
            if found:
                points = None
                if len(data) != len(text):  # code points before each byte
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                for k, start, end in found:
                    if points is not None:
                        start, end = int(points[start]), int(points[end])
                    rule = self.rules[k]
                    if rule.holds is None or rule.holds(text[start:end]):
                        kept.append((start, k, end))
                kept.sort()
            out.append([(self.rules[k].kind, start, end) for start, k, end in kept])
        return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row for each row of docs(doc_id, text): its spans as arrays, by start, then by the rules' order.

    A null text counts as empty; a null doc_id stays null; equal rows give equal rows; further columns
    of docs are ignored. The rows aren't moved: no shuffle, memory for one Arrow batch.
    """
    held: list[SecretScanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(SecretScanner(rules))
        found = held[0].find(texts_of(batch))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([[s[0] for s in x] for x in found], pa.list_(pa.string())),
                pa.array([[s[1] for s in x] for x in found], pa.list_(pa.int32())),
                pa.array([[s[2] for s in x] for x in found], pa.list_(pa.int32())),
            ],
            names=["doc_id", "kind", "start", "end"],
        )

    return map_batches(own_columns(docs, "doc_id", "text"), run, SCHEMA, held)


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
