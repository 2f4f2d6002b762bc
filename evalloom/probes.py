"""Health probes: is the package there, is a session usable, do the judges tell right from wrong?"""

from __future__ import annotations

import copy

from pyspark.sql import SparkSession

from evalloom import __version__, schemas
from evalloom.plans.evaluator import Evaluator
from evalloom.sources.contract import Suite, demo_suite


def liveness() -> dict:
    return {"ok": True, "probe": "liveness", "version": __version__}


def readiness(spark: SparkSession | None) -> dict:
    ok = spark is not None and spark.range(1).count() == 1
    return {"ok": ok, "probe": "readiness", "runtime_dependencies": ["pyspark"], "schema_versions": list(schemas.SUITE_VERSIONS), "report_schema_versions": list(schemas.REPORT_VERSIONS), "judges": list(schemas.JUDGES)}


def _miscited(suite: Suite) -> Suite:
    """The same suite with every claim citing a source that it doesn't have."""
    changed = copy.deepcopy(suite.to_dict())
    for question in changed["questions"]:
        for claim in question["response"]["claims"]:
            claim["citations"] = ["no-such-source"]
    return Suite.from_dict(changed)


def functional(spark: SparkSession) -> dict:
    """Questions of the bundled suite that pass must fail, for that reason, once they cite a source that doesn't exist."""
    evaluator, suite = Evaluator(spark, clock=lambda: 0), demo_suite()
    right, wrong = ({r["question_id"]: r for r in evaluator.run(s)["records"]} for s in (suite, _miscited(suite)))
    controls = [q for q, r in right.items() if r["passed"] and r["claims"]]
    failures = sorted({code for q in controls for code in wrong[q]["failures"]})
    caught = bool(controls) and all("invalid_citation" in wrong[q]["failures"] and not wrong[q]["passed"] for q in controls)
    return {"ok": caught, "probe": "functional", "control_passed": bool(controls), "counter_example_failed": caught, "counter_failures": failures}
