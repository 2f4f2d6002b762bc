"""The JSON contract of a suite: strict reading, bounds, canonical digests.

A suite file is small by contract, so it is read and checked on the driver; its rows then become DataFrames. Tables
read by Spark don't pass through here and have no such bounds.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from importlib import resources
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from evalloom import schemas

# The bounds of the contract.
MAX_DOCUMENTS, MAX_QUESTIONS = 200, 500
MAX_CONTENT, MAX_TEXT = 200_000, 10_000
MAX_SUITE_BYTES, MAX_MANIFEST_BYTES, MAX_REPORT_BYTES = 5_000_000, 32 * 1024 * 1024, 64 * 1024 * 1024
MAX_INDEX_CHUNKS = 100_000
IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")
SEMVER = re.compile(r"(?:0|[1-9]\d*)(?:\.(?:0|[1-9]\d*)){2}", re.ASCII)
DIGEST = re.compile(r"[0-9a-f]{64}")


class ContractError(ValueError):
    """An input breaks the contract."""


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_sha256(value: Any) -> str:
    """SHA-256 of the JSON with sorted keys, no spaces and ASCII escapes."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def strict_json(text: str) -> Any:
    """JSON without duplicate keys."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        out: dict[str, Any] = {}
        for k, v in pairs:
            if k in out:
                raise ContractError(f"duplicate JSON key: {k}")
            out[k] = v
        return out

    try:
        return json.loads(text, object_pairs_hook=once)
    except (json.JSONDecodeError, RecursionError) as problem:
        raise ContractError(f"invalid JSON: {problem}") from problem


def read_bounded(path: str | Path, limit: int, what: str) -> str:
    """A file of at most `limit` bytes as strict UTF-8."""
    try:
        with Path(path).open("rb") as stream:
            data = stream.read(limit + 1)
    except OSError as problem:
        raise ContractError(f"cannot read {what}: {problem}") from problem
    if len(data) > limit:
        raise ContractError(f"{what} exceeds {limit} bytes")
    try:
        return data.decode()
    except UnicodeDecodeError as problem:
        raise ContractError(f"{what} is not UTF-8") from problem


def is_number(value: Any, low: float = -math.inf, high: float = math.inf) -> bool:
    """Whether a value is a finite number in a range; truth values are none."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    try:
        return math.isfinite(value) and low <= value <= high
    except OverflowError:
        return False


Check = Callable[[Any, str], Any]


def _text(limit: int) -> Check:
    def check(value: Any, name: str) -> str:
        if not isinstance(value, str) or not value.strip() or len(value) > limit:
            raise ContractError(f"{name} must be text of 1 to {limit} characters")
        return value

    return check


def _pattern(pattern: re.Pattern, what: str, limit: int = 64) -> Check:
    def check(value: Any, name: str) -> str:
        if not isinstance(value, str) or len(value) > limit or not pattern.fullmatch(value):
            raise ContractError(f"{name} must be {what}")
        return value

    return check


def _one_of(values: tuple[str, ...]) -> Check:
    def check(value: Any, name: str) -> str:
        if value not in values:
            raise ContractError(f"{name} must be one of {', '.join(values)}")
        return value

    return check


def _whole(low: int, high: int) -> Check:
    def check(value: Any, name: str) -> int:
        if type(value) is not int or not low <= value <= high:
            raise ContractError(f"{name} must be a whole number from {low} to {high}")
        return value

    return check


def _flag(value: Any, name: str) -> bool:
    if type(value) is not bool:
        raise ContractError(f"{name} must be true or false")
    return value


def _weight(value: Any, name: str) -> float:
    if not is_number(value, 0, 1):
        raise ContractError(f"{name} must be a finite number from 0 to 1")
    return float(value)


def _date(value: Any, name: str) -> date:
    if not isinstance(value, str) or len(value) > 10:
        raise ContractError(f"{name} must be an ISO date")
    try:
        return date.fromisoformat(value)
    except ValueError as problem:
        raise ContractError(f"{name} must be an ISO date") from problem


def _nullable(check: Check) -> Check:
    return lambda value, name: None if value is None else check(value, name)


def _list(check: Check, low: int = 0, high: int | None = None, unique: bool = False) -> Check:
    def checked(value: Any, name: str) -> list:
        if not isinstance(value, list):
            raise ContractError(f"{name} must be a list")
        if len(value) < low or (high is not None and len(value) > high):
            raise ContractError(f"{name} must have {low} to {high if high is not None else 'any number of'} entries")
        items = [check(v, f"{name}[{i}]") for i, v in enumerate(value)]
        if unique and len(set(items)) != len(items):
            raise ContractError(f"{name} must not repeat entries")
        return items

    return checked


_REQUIRED = object()


def _record(fields: dict[str, tuple[Check, Any]]) -> Check:
    """A JSON object with exactly these fields; the second of each pair is its default, or that there is none."""

    def check(value: Any, name: str) -> dict:
        if not isinstance(value, dict):
            raise ContractError(f"{name} must be an object")
        if unknown := sorted(set(value) - set(fields)):
            raise ContractError(f"{name} has unknown fields: {', '.join(unknown)}")
        out = {}
        for field, (own, default) in fields.items():
            if field in value:
                out[field] = own(value[field], f"{name}.{field}")
            elif default is _REQUIRED:
                raise ContractError(f"{name} lacks {field}")
            else:
                out[field] = default
        return out

    return check


_ID = _pattern(IDENTIFIER, "an identifier of small letters, digits, dots, dashes and underscores")
_need = lambda check: (check, _REQUIRED)
_DOCUMENT = _record({
    "source_id": _need(_ID), "title": _need(_text(200)), "source_url": _need(_text(500)), "license": _need(_text(100)), "observed_at": _need(_date),
    "expires_at": (_nullable(_date), None), "trust": _need(_one_of(schemas.TRUST_STATES)), "content": _need(_text(MAX_CONTENT)), "sha256": _need(_pattern(DIGEST, "a SHA-256 in small hexadecimal digits")),
})
_CLAIM = _record({"text": _need(_text(MAX_TEXT)), "citations": _need(_list(_ID, low=1, unique=True))})
_RESPONSE = _record({"answer": _need(_nullable(_text(MAX_TEXT))), "claims": _need(_list(_CLAIM))})
_QUESTION = _record({
    "question_id": _need(_ID), "text": _need(_text(MAX_TEXT)), "expected_source_ids": _need(_list(_ID, unique=True)), "no_answer": _need(_flag), "adversarial": (_flag, False), "response": _need(_RESPONSE),
})
_SUITE = _record({
    "schema_version": _need(_one_of(("1.0",))), "suite_id": _need(_ID), "version": _need(_pattern(SEMVER, "a semantic version", 32)), "evaluation_date": _need(_date),
    "chunk_size": _need(_whole(8, 500)), "chunk_overlap": _need(_whole(0, 499)), "retrieval_k": _need(_whole(1, 20)), "retrieval_strategy": (_one_of(schemas.STRATEGIES), "overlap"),
    "hybrid_weight": (_weight, 0.5), "documents": _need(_list(_DOCUMENT, 1, MAX_DOCUMENTS)), "questions": _need(_list(_QUESTION, 1, MAX_QUESTIONS)),
})


def _unique(ids: list[str], name: str) -> None:
    if len(set(ids)) != len(ids):
        raise ContractError(f"{name} must be unique")


@dataclass(frozen=True)
class Suite:
    """A checked suite: its settings with documents and questions as plain records."""

    data: dict

    @classmethod
    def from_dict(cls, value: Any) -> Suite:
        data = _SUITE(value, "suite")
        if data["chunk_overlap"] >= data["chunk_size"]:
            raise ContractError("suite.chunk_overlap must be smaller than chunk_size")
        sources = [d["source_id"] for d in data["documents"]]
        _unique(sources, "source ids")
        _unique([q["question_id"] for q in data["questions"]], "question ids")
        for q in data["questions"]:
            name, response = q["question_id"], q["response"]
            if q["no_answer"] != (not q["expected_source_ids"]):
                raise ContractError(f"question {name} must expect sources exactly if it has an answer")
            if (response["answer"] is None) != (not response["claims"]):
                raise ContractError(f"question {name} must have claims exactly if its response has an answer")
            if unknown := sorted(set(q["expected_source_ids"]) - set(sources)):
                raise ContractError(f"question {name} expects unknown sources: {', '.join(unknown)}")
        return cls(data)

    @classmethod
    def from_json(cls, text: str) -> Suite:
        if not isinstance(text, str):
            raise ContractError("a suite must be text")
        if len(text.encode("utf-8", "surrogatepass")) > MAX_SUITE_BYTES:
            raise ContractError(f"suite exceeds {MAX_SUITE_BYTES} bytes")
        return cls.from_dict(strict_json(text))

    @classmethod
    def load(cls, path: str | Path) -> Suite:
        return cls.from_json(read_bounded(path, MAX_SUITE_BYTES, "suite"))

    def __getattr__(self, name: str) -> Any:
        try:
            return self.data[name]
        except KeyError as problem:
            raise AttributeError(name) from problem

    def replace(self, **settings: Any) -> Suite:
        return Suite(self.data | settings)

    def to_dict(self) -> dict:
        """The canonical form; strategy and weight are left out if both are the defaults."""
        plain = lambda d: {k: v.isoformat() if isinstance(v, date) else v for k, v in d.items()}
        out = plain(self.data) | {"documents": [plain(d) for d in self.data["documents"]]}
        if self.data["retrieval_strategy"] == "overlap" and self.data["hybrid_weight"] == 0.5:
            del out["retrieval_strategy"], out["hybrid_weight"]
        return out

    @property
    def digest(self) -> str:
        return canonical_sha256(self.to_dict())

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The suite as tables: documents, questions, suites."""
        d = self.data
        row = lambda schema, values: tuple(values[c.strip().split(" ")[0]] for c in schema)
        names = lambda ddl: [f.name for f in spark.createDataFrame([], ddl).schema]
        pick = lambda ddl, records: spark.createDataFrame([row(names(ddl), r) for r in records], ddl)
        documents = [x | {"suite_id": d["suite_id"], "doc_pos": i} for i, x in enumerate(d["documents"])]
        questions = [x | {"suite_id": d["suite_id"], "question_pos": i} for i, x in enumerate(d["questions"])]
        return pick(schemas.DOCUMENTS, documents), pick(schemas.QUESTIONS, questions), pick(schemas.SUITES, [d])


def demo_suite() -> Suite:
    """The bundled suite."""
    return Suite.from_json(resources.files("evalloom").joinpath("data/demo.json").read_text(encoding="utf-8"))
