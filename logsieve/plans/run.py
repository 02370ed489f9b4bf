"""A whole triage run over one set of source tables.

Scoring reads the logs once and writes the outcome to the shared folder, split into
candidates and left-out rows; every later table reads from there.
"""

import copy
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logsieve import rules
from logsieve.operators import bursts, canon, incidents, nearby, noise, responses, score, triage
from logsieve.sources import store

c = F.col


class TriageRun:
    """Tables of a run. Each is written once when it is first asked for, and counted as it is written."""

    def __init__(
        self,
        tables: dict[str, DataFrame],
        sources="security",
        min_score: int = rules.MIN_SCORE,
        min_repeat: int = rules.MIN_REPEAT,
        known_assets=(),
        triage_mode: str = "faithful",
        start=None,
        end=None,
        answers: DataFrame | None = None,
    ):
        """``start``, ``end``: only requests of that time are read (end exclusive).

        ``answers``: a model's answers; triage then works on those that are valid, not on the rules' own verdicts.
        """
        self.start, self.end = start, end
        self.answers = answers
        self._rows: dict[str, dict[str, int]] = {}
        self.tables = {n: canon.within(df, start, end) for n, df in tables.items()}
        self.sources = sources
        self.min_score = min_score
        self.min_repeat = min_repeat
        self.known_assets = known_assets
        self.triage_mode = triage_mode

    def with_answers(self, answers: DataFrame) -> "TriageRun":
        """The same run, its tables included, with a model's answers."""
        self.incidents  # noqa: B018  written once for both
        other = copy.copy(self)
        other.answers, other._rows = answers, dict(self._rows)
        for name in ("results", "deduped"):
            other.__dict__.pop(name, None)
        return other

    def _stored(self, name: str, df: DataFrame, **counts: Column) -> DataFrame:
        """The written table; its rows (and other counts) are taken by the job that writes it."""
        seen = Observation()
        out = store.materialize(df.observe(seen, F.count("*").alias("rows"), *[v.alias(k) for k, v in counts.items()]), name)
        self._rows[name] = seen.get
        return out

    def rows(self, name: str) -> int:
        """Rows of a table of the run, known since it was written."""
        getattr(self, name)
        return self._rows[name]["rows"]

    @cached_property
    def requests(self) -> DataFrame:
        return canon.select_sources(self.tables, self.sources)

    @cached_property
    def exported_rows(self) -> int:
        """Rows of all tables of the export, selected or not; the selected ones are counted with the outcome."""
        chosen = canon.source_names(self.sources)
        rest = [df for n, df in self.tables.items() if n not in chosen]
        return self._rows["outcome"]["rows"] + sum(df.count() for df in rest)

    @cached_property
    def judged(self) -> DataFrame:
        return score.judge(self.requests, self.min_score)

    @cached_property
    def outcome(self) -> DataFrame:
        """The written outcome of scoring, in folders by ``is_candidate``."""
        spark = self.requests.sparkSession
        path = store.scratch_path(spark, "outcome")
        hit = c("verdict_hint").isNotNull()
        wanted = dict.fromkeys(
            [*score.CANDIDATE_COLUMNS, *score.FILTERED_COLUMNS, "raw_request", "probe_path"]
        )
        rows = self.judged.withColumns(
            {
                "is_candidate": hit,
                "reason_hints": F.when(hit, score.reason_hints()),
                "embedded_attack_hint": score.embedded_attack(),
                "log_text": F.when(hit, c("log_text")),
            }
        ).select("is_candidate", *wanted)
        seen = Observation()
        counted = rows.observe(seen, F.count("*").alias("rows"), F.count_if(c("is_candidate")).alias("hits"))
        counted.write.partitionBy("is_candidate").parquet(path)
        self._rows["outcome"] = seen.get
        return spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def candidates(self) -> DataFrame:
        rows = self.outcome.where("is_candidate")
        shown = F.when(c("uri") == "", F.lit("-")).otherwise(c("uri"))
        return rows.withColumn("uri", shown).select(*score.CANDIDATE_COLUMNS)

    @cached_property
    def left_out(self) -> DataFrame:
        return self.outcome.where("not is_candidate").select(*score.FILTERED_COLUMNS)

    @cached_property
    def noise_groups(self) -> DataFrame:
        return self._stored("noise_groups", noise.noise_groups(self.left_out, self.min_repeat))

    @cached_property
    def passed_through(self) -> DataFrame:
        return self._stored("passed_through", noise.passed_through(self.left_out, self.min_repeat))

    @cached_property
    def review(self) -> DataFrame:
        return self._stored("review", noise.false_positive_review(self.passed_through))

    @cached_property
    def incidents(self) -> DataFrame:
        """Incidents with ``candidate_index``."""
        return self._stored("incidents", incidents.with_candidate_index(incidents.incidents(self.candidates)))

    @cached_property
    def members(self) -> DataFrame:
        return incidents.incident_members(self.candidates)

    @cached_property
    def supporting(self) -> DataFrame:
        return self._stored("supporting", nearby.supporting_events(self.left_out, self.incidents, self.min_score))

    @cached_property
    def bursts(self) -> DataFrame:
        """From all rows, candidates included."""
        return self._stored("bursts", bursts.probing_bursts(self.outcome))

    @cached_property
    def results(self) -> DataFrame:
        if self.answers is None:
            return triage.rule_triage(self.incidents, self.triage_mode)
        checked = responses.validate_responses(responses.parse_responses(self.answers))
        return responses.classified(checked.where("valid"), self.incidents)

    @cached_property
    def deduped(self) -> DataFrame:
        return self._stored("deduped", triage.triage_dedup(self.results, self.known_assets))

    @cached_property
    def counts(self) -> DataFrame:
        """The stage counters, one row per counter, as counted while the tables were written."""
        rows = self.rows
        total = rows("outcome")
        hits = self._rows["outcome"]["hits"]
        merged = rows("incidents")
        values = {
            "selected_source_rows": total,
            "filtered_out_rows": total - hits,
            "candidate_rows_before_dedup": hits,
            "total_exported_rows": self.exported_rows,
            "candidate_rows": merged,
            "distinct_incident_candidates": merged,
            "candidate_duplicate_rows_removed": hits - merged,
            "filtered_out_non_aggregated_rows": rows("passed_through"),
            "noise_group_count": rows("noise_groups"),
            "supporting_events": rows("supporting"),
            "false_positive_review_candidates": rows("review"),
            "probing_sequence_summaries": rows("bursts"),
        }
        spark = self.outcome.sparkSession
        return spark.createDataFrame(list(values.items()), "counter string, value bigint")
