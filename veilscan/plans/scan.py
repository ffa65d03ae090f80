"""The whole audit as one plan.

The text is read once.  Given a shared folder, that pass leaves a narrow table of matches and
facts per screen there and everything after works on that; without one the plan stays whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veilscan.functions.tables import explode_rows
from veilscan.operators.layout import layout_entities
from veilscan.operators.provenance import scanned_lines, scanned_types, with_provenance
from veilscan.operators.resolve import (
    candidates,
    evidence,
    resolve_entities,
    resolve_with_fallback,
    scan_text,
    scanned_matches,
)
from veilscan.operators.rules import rule_features
from veilscan.operators.structure import line_table, structured_screens
from veilscan.operators.verdict import verdict_rows


class Stages:
    """Tables written below a shared folder and read back, or nothing without a folder."""

    def __init__(self, folder: str | None) -> None:
        self.folder, self.paths = folder, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if not self.folder:
            return df
        path = f"{self.folder.rstrip('/')}/veilscan/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return df.sparkSession.read.parquet(path)

    def drop(self, spark: SparkSession) -> None:
        """Delete the written tables; what was read from them can't be read any more."""
        for path in self.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


@dataclass
class Audit:
    """Tables of one audit."""

    scanned: DataFrame
    candidates: DataFrame
    entities: DataFrame
    features: DataFrame
    verdicts: DataFrame
    stages: Stages
    lines: DataFrame | None = None

    def located(self, max_row: int | None = None) -> DataFrame:
        """Entities with context, lines, blocks, box, label, reason and document type.

        Needs the lines: an audit of blocks has them, one of texts keeps them with ``context``.
        """
        if self.lines is None:
            raise ValueError("audit(..., context=True) keeps the lines that this needs")
        return with_provenance(self.entities, self.lines, scanned_types(self.scanned), max_row)

    def drop(self) -> None:
        """Delete the tables that the audit has written, once its results are stored."""
        self.stages.drop(self.verdicts.sparkSession)

    @property
    def violations(self) -> DataFrame:
        return explode_rows(self.verdicts, "violations", "v", "screen_id", "session_id").select(
            "screen_id", "session_id", "v.*"
        )


def audit(
    screens: DataFrame, decisions: DataFrame | None = None, layout: DataFrame | None = None,
    folder: str | None = None, stages: Stages | None = None, context: bool = False, lines: DataFrame | None = None,
) -> Audit:
    """Entities and verdicts of all screens.

    ``decisions`` are external type decisions per value; without them the fallback ones
    are used.  ``layout`` are layout matches of screens that have blocks.  ``folder`` is shared by
    all executors; the tables written there stay until ``Audit.drop``.  ``context`` keeps the
    lines around matches for ``Audit.located``; ``lines`` are those of screens that have blocks.
    """
    stages = stages or Stages(folder)
    keep = stages.keep
    scanned = keep(scan_text(screens, context), "scanned")
    if context:
        lines = scanned_lines(scanned)
    cands = candidates(evidence(scanned_matches(scanned, layout)))
    entities = resolve_with_fallback(cands) if decisions is None else resolve_entities(cands, decisions)
    entities = keep(entities, "entities")
    facts = scanned.drop("found", "near_lines")
    features = rule_features(facts, entities)
    return Audit(scanned, cands, entities, features, verdict_rows(features), stages, lines)


def audit_blocks(
    blocks: DataFrame, screen_columns: DataFrame, decisions: DataFrame | None = None, folder: str | None = None
) -> Audit:
    """The audit of screens given as blocks; ``screen_columns`` has session, user and time."""
    stages = Stages(folder)
    lines = stages.keep(line_table(blocks), "lines")
    text = structured_screens(lines)
    own = [c for c in screen_columns.columns if c not in ("full_text", "avg_confidence", "line_conf")]
    screens = screen_columns.select(*own).join(text, "screen_id")
    return audit(screens, decisions, layout_entities(lines, text), stages=stages, lines=lines)
