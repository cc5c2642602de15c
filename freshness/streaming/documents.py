"""Maintenance of passage vectors for many (policy, budget) runs: which edited documents are embedded again, and what that does to retrieval.

A round takes its edits, lets each run publish the newest revision of as many waiting documents as its budget allows, and only then answers
its questions over the passages of the revision in force; 1 - hit@1 is added to the document's error, which ranks the next round.

A question's result depends on the revision it is asked of and not on the run. Results are kept in a memo of (question, revision): a round
scores the pairs that are not in it yet, once for all runs. When the logs are compacted, pairs whose revision is in force in no run go.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshness.operators.docs import retrieval_scores
from freshness.streaming.maintenance import Maintenance, Model, Run

SCORES = ["top1", "top5", "top10", "doc_size"]


class DocumentMaintenance(Maintenance):
    """Rounds over a stream of edits (`doc_id`, `revid`, `ts`) and questions (`ask_id`, `doc_id`, `question_id`), told apart by which id is null.

    Every row carries `init_revid`, the revision its document starts with; null marks a document that is not held. Edits of such documents are
    skipped; their questions come out without a version and are counted as unknown. `questions` has (question_id, vector, answer),
    `passages` (revid, passage, vector, text), or both are what another `score` takes, such as `retrieval_scores_by_document`. A revision without passages answers nothing: no hits, size 0. Of several edits in one
    round the one with the highest (ts, revid) counts, and a later round replaces an earlier one.
    """

    def __init__(self, spark: SparkSession, path: str, runs: Sequence[Run], questions: DataFrame, passages: DataFrame, compact_every: int = 8,
                 score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = retrieval_scores):
        newest = Model(sums=None, fit=lambda: F.col("revid"), predict=None, cold=0.0)
        super().__init__(spark, path, runs, newest, "doc_id", "", known=F.col("init_revid").isNotNull(), update_first=True, compact_every=compact_every)
        self.questions, self.passages, self.score = questions, passages, score

    def run_batch(self, batch: DataFrame, round_no: int) -> None:
        """One round: edits, refreshes, questions."""
        super().run_batch(batch, round_no)
        if (round_no + 1) % self.compact_every == 0:
            self._write(self._in_force(self._memo(round_no), round_no), "scores", round_no, "base")

    def _add_sums(self, events: DataFrame, round_no: int) -> DataFrame:
        """Append the newest revision of the documents edited in this round; (doc_id, _new): edits of each."""
        edits = events.where("_known and revid is not null").groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("_new"), F.max_by("revid", F.struct("ts", "revid")).alias("revid"))
        return self._write(edits.withColumn("round_no", F.lit(round_no)), "sums", round_no).select("doc_id", "_new")

    def _memo(self, upto: int) -> DataFrame | None:
        """Results so far; a pair is in one row only, as no pair that is held is scored again."""
        return self._read("scores", self._span("scores", upto)) if upto >= 0 else None

    def _in_force(self, memo: DataFrame, round_no: int) -> DataFrame:
        """Results of revisions that some run answers with: published there last, or the first one where none was."""
        features = self._log("features", ["run", "doc_id"], round_no, "doc_id")
        held = features.groupBy("doc_id").agg(F.collect_set("feature").alias("_held"), F.count(F.lit(1)).alias("_n"))  # at most one a run
        used = F.array_contains("_held", F.col("version")) | (F.col("is_first") & (F.coalesce("_n", F.lit(0)) < len(self.runs)))
        return memo.join(held, "doc_id", "left").where(F.coalesce(used, F.lit(False))).select(memo.columns)

    def _answer(self, events: DataFrame, features_upto: int, round_no: int) -> DataFrame:
        """Write the round's results in every run; the `_errors` of the documents that are held.

        A question is one row with the versions of all runs until its results are known, and is repeated for the runs only then.
        """
        asked = events.where("question_id is not null").select("ask_id", "doc_id", "question_id", "init_revid")
        published = self._log("features", ["run", "doc_id"], features_upto, "doc_id").groupBy("doc_id").agg(
            F.map_from_entries(F.collect_list(F.struct("run", "feature"))).alias("_features"))
        newest = self._log("sums", ["doc_id"], round_no).select("doc_id", F.col("revid").alias("newest"))
        versions = F.transform(self._run_numbers(), lambda run: F.coalesce(F.try_element_at("_features", run), "init_revid"))
        joined = asked.join(published, "doc_id", "left").join(newest, "doc_id", "left")
        joined = joined.withColumn("versions", F.when(F.col("init_revid").isNotNull(), versions)).drop("_features")
        joined = self._write(joined, "asked", round_no)
        pairs = joined.select("doc_id", "question_id", "init_revid", F.explode(F.array_distinct("versions")).alias("version"))
        pairs = pairs.groupBy("question_id", "version").agg(F.first("doc_id").alias("doc_id"), F.first(F.col("version") == F.col("init_revid")).alias("is_first"))
        memo = self._memo(round_no - 1)
        if memo is not None:
            pairs = pairs.join(memo, ["question_id", "version"], "left_anti")
        found = self.score(pairs, self.questions, self.passages).select("question_id", "version", "doc_id", "is_first", *SCORES)
        known = self._write(found, "scores", round_no)
        if memo is not None:
            known = known.unionByName(memo)
        by_question = known.groupBy("question_id").agg(F.collect_list(F.struct("version", *SCORES)).alias("_known"))
        version = F.get("versions", F.col("run")).alias("version")
        rows = joined.join(by_question, "question_id", "left").select("*", self._all_runs()).select("*", version)
        rows = rows.withColumn("_found", F.get(F.filter("_known", lambda x: x["version"] == F.col("version")), F.lit(0)))
        is_fresh = F.col("version") == F.coalesce("newest", "init_revid")
        rows = rows.select("run", "doc_id", "ask_id", "question_id", "version", is_fresh.alias("is_fresh"), *[f"_found.{c}" for c in SCORES], F.lit(round_no).alias("round_no"))
        answers = self._write(rows, "predictions", round_no).where("version is not null")
        return self._errors(answers, 1.0 - F.col("top1"))
