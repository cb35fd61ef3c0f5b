"""Tables in between: a corpus is scanned once, and what several plans read is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property, lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.findings import LAYOUT_SCORERS, SCORERS, Model, all_findings, generic_phrases, line_findings, with_said, with_work
from vellum.operators.keywords import match_targets
from vellum.operators.layout import Layout
from vellum.operators.lines import classify_lines, with_marks
from vellum.operators.score import category_scores
from vellum.operators.sections import assign_sections, attach_entries, contact_fields, entry_table, years_of_experience
from vellum.operators.texts import by_text, with_column
from vellum.plans.corpus import derived_corpus, derived_layout
from vellum.plans.terms import default_targets, default_terms
from vellum.sources.text import with_fonts


def written(frame: DataFrame) -> DataFrame:
    """The rows of frame from a table in the folder that spark.checkpoint.dir names. A local session that names none, as in tests, gets one of its own; a cluster must name one that executors share."""
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Removes the tables that this application has written, once no result needs them any more."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{named}/{spark.sparkContext.applicationId}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _classified(lines: DataFrame) -> DataFrame:
    """Lines with words, marks and kinds."""
    return classify_lines(by_text(lines, lambda t: with_marks(with_fonts(t)), written))


def build_model(lines: DataFrame, terms: DataFrame, targets: DataFrame, as_of_year: int, layout: Layout | None = None) -> Model:
    """The document model of a corpus of lines (doc_id, line_no, text), as written tables. What the rules ask of each line is computed once, with the model."""
    whole = written(with_work(by_text(written(attach_entries(assign_sections(_classified(lines)))), with_said, written)))
    entries = written(entry_table(whole, hold=written))
    return Model(whole, entries, written(contact_fields(whole, hold=written)), years_of_experience(entries, as_of_year), written(match_targets(whole, terms, targets, hold=written)), layout)


def build_findings(m: Model) -> DataFrame:
    """All findings, capped. Each scorer's are written before the union: one small plan for each instead of one that is replanned as a whole at every stage."""
    return all_findings(m, hold=written)


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables that the corpus comes from were last changed."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    paths = [hadoop.Path(f"{sf_dir}/{name}.parquet") for name in ("customer", "orders", "lineitem")]
    return tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


class Corpus:
    """The tables of the derived corpus. Each is computed and written when a query first asks for it, with those that it comes from and no others."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._sf_dir, self.roles = spark, sf_dir, None
        self._scored: dict[str, DataFrame] = {}

    @cached_property
    def text(self) -> DataFrame:
        """(doc_id, line_no, text)."""
        return written(derived_corpus(self._spark, self._sf_dir))

    @cached_property
    def read(self) -> DataFrame:
        """Lines with sections and entries, but without what the rules ask of each."""
        return written(attach_entries(assign_sections(self.classified)))

    @property
    def classified(self) -> DataFrame:
        """Lines with words and kinds, not written."""
        return _classified(self.text)

    @cached_property
    def lines(self) -> DataFrame:
        return written(with_work(by_text(self.read, with_said, written)))

    @cached_property
    def entries(self) -> DataFrame:
        return written(entry_table(self.read, hold=written))

    @cached_property
    def contact(self) -> DataFrame:
        return written(contact_fields(self.read, hold=written))

    @cached_property
    def years(self) -> DataFrame:
        return years_of_experience(self.entries, 2024)

    @cached_property
    def matches(self) -> DataFrame:
        return written(match_targets(self.read, default_terms(self._spark), default_targets(self._spark), hold=written))

    @cached_property
    def layout(self) -> Layout:
        own = derived_layout(self._spark, self._sf_dir)
        return Layout(written(own.items), written(own.images), written(own.files), hold=written)

    @cached_property
    def model(self) -> Model:
        return Model(self.lines, self.entries, self.contact, self.years, self.matches, self.layout)

    def scored(self, scorer: str) -> DataFrame:
        """The capped findings of one scorer. No rule, and no shared cap, belongs to two."""
        if scorer not in self._scored:
            own = {scorer: (SCORERS | LAYOUT_SCORERS)[scorer]}
            self._scored[scorer] = written(all_findings(self, own, hold=written))
        return self._scored[scorer]

    def line_rule(self, rule: str) -> DataFrame:
        """The capped findings of one rule of lines; no other rule is tested for it. The many generic phrases are looked for once in each text that recurs."""
        own = by_text(self.read, with_column("generic", generic_phrases(F.col("text"))), written) if rule == "generic-phrase" else self.read
        return all_findings(Model(own, *[None] * 4), {"lines": lambda m: line_findings(m, (rule,))})

    @cached_property
    def findings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.scored(s) for s in SCORERS | LAYOUT_SCORERS])

    @cached_property
    def scores(self) -> DataFrame:
        return written(category_scores(self.model, self.findings))


@lru_cache(maxsize=4)
def _corpus(application: str, sf_dir: str, stamp: tuple) -> Corpus:
    return Corpus(SparkSession.getActiveSession(), sf_dir)


def _of(spark: SparkSession, sf_dir: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _corpus(*_of(spark, sf_dir))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).text


def corpus_model(spark: SparkSession, sf_dir: str) -> Model:
    return corpus(spark, sf_dir).model


def corpus_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).findings


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).scores
