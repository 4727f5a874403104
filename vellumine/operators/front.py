"""Front matter chosen from a paper's first blocks, abstracts as spans, paper types, and readings of whole corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOILERPLATE = r"(?i)^(research article|original article|review|open access|article info|available online|received|accepted|contents lists|journal homepage|©|copyright|vol(ume)?\.?\s*\d|doi|https?://|www\.)"
_PEOPLE = r"^(?:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}\.?)*\s\p{Lu}[\p{L}'’-]+)(?:\s*[\d*†,]*\s*(?:,|and|&)\s*(?:\p{Lu}[\p{L}'’-]+(?:\s\p{Lu}\.?)*\s\p{Lu}[\p{L}'’-]+))*[\s\d*†,]*$"


def front_matter(blocks: DataFrame) -> DataFrame:
    """paper_id, title, authors, rule (T13): the record block of a paper's first page, or none where two are equally good.

    A record is a block of 3 to 40 words that is no boilerplate, right before a block that is a list of people; failing that,
    the only first-level heading above the abstract. ``blocks``: paper_id, block_id, page, kind, text.
    """
    w = Window.partitionBy("paper_id").orderBy("block_id")
    text = F.trim("text")
    ends = F.max(F.lower(text).rlike(r"^(abstract|summary|introduction|1\.?\s+introduction)\b").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
    rows = blocks.withColumn("over", ends).withColumn("next", F.lead(text).over(w)).where("page = 1 AND over = 0")
    good = words.between(3, 40) & ~text.rlike(BOILERPLATE) & ~text.rlike(_PEOPLE)
    tier = F.when(good & F.coalesce(F.col("next").rlike(_PEOPLE), F.lit(False)), 0).when(good & (F.col("kind") == "heading"), 1)
    found = rows.select("paper_id", "block_id", text.alias("title"), "next", tier.alias("tier")).where("tier IS NOT NULL")
    best = found.withColumn("best", F.min("tier").over(Window.partitionBy("paper_id"))).where("tier = best")
    one = best.groupBy("paper_id").agg(F.countDistinct(F.lower("title")).alias("k"), F.min(F.struct("block_id", "title", "next", "tier")).alias("b"))
    sure = F.col("k") == 1
    return one.select(
        "paper_id", F.when(sure, F.col("b.title")).alias("title"), F.when(sure & (F.col("b.tier") == 0), F.regexp_replace("b.next", r"[\d*†]+", "")).alias("authors"),
        F.when(~sure, "abstain").when(F.col("b.tier") == 0, "title_over_people").otherwise("only_heading").alias("rule"),
    )


def abstract_spans(blocks: DataFrame, least: int = 40) -> DataFrame:
    """paper_id, first_id, last_id, rule (T15): the blocks under a heading ``Abstract``, else the first paragraph of ``least`` words
    above the first heading that is an introduction. ``blocks``: paper_id, block_id, kind, text."""
    w = Window.partitionBy("paper_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    low, head = F.lower(F.trim("text")), F.col("kind") == "heading"
    rows = blocks.withColumn("section", F.sum(head.cast("int")).over(w)).withColumn("named", F.last(F.when(head, low), True).over(w)).withColumn("begun", F.max((head & low.rlike("introduction|background")).cast("int")).over(w))
    printed = rows.where(~head & F.col("named").rlike(r"^(abstract|summary)\b")).groupBy("paper_id", "section").agg(F.min("block_id").alias("first_id"), F.max("block_id").alias("last_id"))
    printed = printed.groupBy("paper_id").agg(F.min(F.struct("first_id", "last_id")).alias("b")).select("paper_id", "b.*", F.lit("heading").alias("rule"))
    intro = rows.groupBy("paper_id").agg(F.max("begun").alias("any"))
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != ""))
    loose = rows.where(~head & (F.col("begun") == 0) & (words >= least)).join(intro.where("any = 1"), "paper_id", "left_semi").groupBy("paper_id").agg(F.min("block_id").alias("first_id"))
    loose = loose.join(printed, "paper_id", "left_anti").select("paper_id", "first_id", F.col("first_id").alias("last_id"), F.lit("before_introduction").alias("rule"))
    return printed.unionByName(loose)


#: Paper types and research fields (the OECD's six major ones) with words that name them, lower case.
TYPES = {"review": "systematic review,scoping review,meta-analysis,literature review,review", "protocol": "study protocol,registered report,protocol", "commentary": "commentary,editorial,letter,reply,opinion", "case report": "case report,case study", "empirical": "empirical,original article,research article,experiment"}
FIELDS = {
    "natural sciences": "physics,chemistry,biology,mathematics,computer science,earth science", "engineering and technology": "engineering,materials,biotechnology,nanotechnology", "medical and health sciences": "medicine,clinical,health,nursing,pharmacology",
    "agricultural and veterinary sciences": "agriculture,forestry,veterinary,fisheries", "social sciences": "psychology,economics,sociology,education,political science,law", "humanities and the arts": "history,philosophy,linguistics,literature,arts",
}


def canonical_label(text: Column, table: dict[str, str]) -> Column:
    """The label (T34) that a text names, the longest name of all that stand in it between word borders; null where none does."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}-]+", " ")), F.lit(" "))
    hits = [F.when(padded.contains(f" {name} "), F.struct(F.lit(len(name)).alias("n"), F.lit(label).alias("label"))) for label, names in table.items() for name in (label, *names.split(","))]
    return F.array_max(F.array_compact(F.array(*hits)))["label"]


def text_gates(docs: DataFrame, least_letters: float = 0.5, least_known: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, letters, known, passes (T31): the share of letters among characters that are no blanks, and of a text's words that another
    text has too; a text without words does not pass. Words are counted over all texts.

    A word is a text's own if the first and the last key that have it are one. Only those are counted by text, so that what is
    shuffled are the words of a task and not those of each text."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    spread = docs.select(key, F.explode(words).alias("word")).groupBy("word").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"), F.count(key).alias("keyed"))
    own = spread.where("low = high AND keyed = n").groupBy(F.col("low").alias(key)).agg(F.sum("n").alias("own"))
    solid = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\s\p{Z}]+", "")
    share = F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"\P{L}+", "")) / F.length(solid)).otherwise(0.0)
    # Repeats of a key are one text.
    out = docs.select(key, F.round(share, 6).alias("letters"), F.size(words).alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy(key))).join(own, key, "left")
    out = out.withColumn("known", F.when(F.col(key).isNotNull() & (F.col("n") > 0), (F.col("n") - F.coalesce("own", F.lit(0))) / F.col("n")))
    return out.select(key, "letters", F.round("known", 6).alias("known"), F.coalesce((F.col("letters") >= least_letters) & (F.col("known") >= least_known), F.lit(False)).alias("passes"))


def glyph_cells(chars: DataFrame, gap: float = 1.5) -> DataFrame:
    """page_id, line, cell, n (T29): characters of a line put together to cells, which a gap of ``gap`` median heights of the page parts."""
    from .sections import group_lines

    lines = group_lines(chars)
    heights = chars.groupBy("page_id").agg(F.median("height").alias("usual"))
    w = Window.partitionBy("page_id", "line").orderBy("x", "char_id")
    apart = F.coalesce(F.col("x") - F.lag("x").over(w) > gap * F.col("usual"), F.lit(False)).cast("long")
    cells = lines.join(heights, "page_id").withColumn("apart", apart).withColumn("cell", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cells.groupBy("page_id", "line", "cell").agg(F.count(F.lit(1)).alias("n"))


# --- models ------------------------------------------------------------------------------------------------------------

_MODELS: dict[str, tuple[Callable[[], Callable], str]] = {}


def register(name: str, schema: str):
    """Name a model: the decorated function is called once per task and returns one that maps a list of texts to rows of ``schema``."""

    def keep(make):
        _MODELS[name] = (make, schema)
        return make

    return keep


def apply_model(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the rows that the model gives for each text, in Arrow batches; an unknown name is an error that lists the known ones."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if name not in _MODELS:
        raise KeyError(f"no model {name!r}; known: {sorted(_MODELS)}")
    make, schema = _MODELS[name]
    struct = _parse_datatype_string(f"{key} {docs.schema[key].dataType.simpleString()}, {schema}")
    arrow = to_arrow_schema(struct)

    def run(batches):
        model = make()
        for batch in batches:
            rows = [(k, *r) for k, r in zip(batch.column(0).to_pylist(), model(batch.column(1).to_pylist()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], names=[f.name for f in arrow])

    return docs.select(key, text).mapInArrow(run, struct)


@register("statement_tagger", "field string, score double")
def _statement_rule():
    """The rule that stands in for a statement tagger's weights (T35): the first field whose anchor a text holds."""
    from ..functions.statements import ANCHORS, FIELDS

    def model(texts):
        return [next(((f, 1.0) for f in FIELDS if ANCHORS[f].search(t or "")), (None, 0.0)) for t in texts]

    return model
