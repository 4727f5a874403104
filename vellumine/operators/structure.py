"""Section trees, page regions, captions and spans: order rules as windows, geometry as band joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_parents(sections: DataFrame) -> DataFrame:
    """paper_id, section_id, number, parent_id (W3): a numbered heading's parent is the last earlier one that carries its number
    without the last part, else the longest earlier prefix of it; unnumbered headings and first parts have none.

    ``sections``: paper_id, section_id (reading order), header.
    """
    printed = F.regexp_extract(F.coalesce("header", F.lit("")), r"^\s*((?:[A-Z]|\d+)(?:\.\d+)*)\.?(?=\s|$)", 1)
    rows = sections.select("paper_id", "section_id", F.when(printed.rlike(r"\d"), printed).alias("number"))
    parts = F.split("number", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    asks = rows.where(F.size(parts) > 1).select("paper_id", F.col("section_id").alias("child"), F.explode(prefixes).alias("number"))
    # The last earlier heading of a number: an as-of join by one union and window, where a heading's own asks come before it.
    both = asks.select("paper_id", "number", F.col("child").alias("at"), F.lit(0).alias("side"), "child", F.lit(None).cast(rows.schema["section_id"].dataType).alias("section_id"))
    both = both.union(rows.where("number IS NOT NULL").select("paper_id", "number", F.col("section_id").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(rows.schema["section_id"].dataType).alias("child"), "section_id"))
    last = F.last("section_id", True).over(Window.partitionBy("paper_id", "number").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("section_id", F.when(F.col("side") == 0, last)).where("section_id IS NOT NULL")
    best = found.groupBy("paper_id", "child").agg(F.max(F.struct(F.length("number").alias("n"), "section_id")).alias("b")).select("paper_id", F.col("child").alias("section_id"), F.col("b.section_id").alias("parent_id"))
    return rows.join(best, ["paper_id", "section_id"], "left")


CORE = ("introduction", "methods", "results", "discussion")


def sane_sections(sections: DataFrame) -> DataFrame:
    """paper_id, section_id, section_type (W10): an abstract behind the first methods or results, and references in the first
    half with core sections still to come, become unknown. ``sections``: paper_id, section_id, section_type."""
    by = Window.partitionBy("paper_id")
    # What comes after is the whole less what came up to here; a frame up to the end would be summed anew for every row.
    upto, here = (by.orderBy("section_id").rowsBetween(Window.unboundedPreceding, x) for x in (-1, 0))
    body, core = F.col("section_type").isin("methods", "results").cast("int"), F.col("section_type").isin(*CORE).cast("int")
    place, size = F.row_number().over(by.orderBy("section_id")), F.count(F.lit(1)).over(by)
    late = (F.col("section_type") == "abstract") & (F.coalesce(F.sum(body).over(upto), F.lit(0)) > 0)
    early = (F.col("section_type") == "references") & (place * 2 <= size) & (F.coalesce(F.sum(core).over(by) - F.coalesce(F.sum(core).over(here), F.lit(0)), F.lit(0)) > 0)
    return sections.select("paper_id", "section_id", F.when(late | early, "unknown").otherwise(F.col("section_type")).alias("section_type"))


def carried_over(blocks: DataFrame) -> DataFrame:
    """Paragraphs that run on over a page's end joined (W11): paper_id, first_id, n_parts, text.

    A block that opens a page is carried on if the last one of the page before ends without closing punctuation and it starts
    in lower case; a broken word is joined. ``blocks``: paper_id, block_id (reading order), page, text.
    """
    w = Window.partitionBy("paper_id").orderBy("block_id")
    before = F.lag("text").over(w)
    on = (F.col("page") > F.lag("page").over(w)) & ~F.rtrim(before).rlike("[.!?:;]$") & F.ltrim("text").rlike(r"^\p{Ll}")
    rows = blocks.withColumn("start", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("group", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy("paper_id", "group").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("b"))
    text = F.regexp_replace(F.array_join(F.transform("b", lambda x: F.trim(x["text"])), "\u0001"), "(?<=\\p{Ll})-\u0001(?=\\p{Ll})", "")
    return joined.select("paper_id", F.col("b")[0]["block_id"].alias("first_id"), F.size("b").cast("long").alias("n_parts"), F.replace(text, F.lit("\u0001"), F.lit(" ")).alias("text"))


def caption_continuations(regions: DataFrame, most: int = 2) -> DataFrame:
    """paper_id, region_id, caption_id (W12): text regions right behind a caption of their page that runs on, ``most`` in a row.

    A caption runs on while what was read of it does not end a sentence. ``regions``: paper_id, region_id, page, kind, text.
    """
    w = Window.partitionBy("paper_id", "page").orderBy("region_id")
    open_end = ~F.coalesce(F.rtrim("text").rlike("[.!?]$"), F.lit(False))
    rows = regions.withColumn("open", open_end)
    parts = []
    for step in range(1, most + 1):
        chain = F.lag("kind", step).over(w) == "caption"
        for back in range(1, step + 1):
            chain = chain & F.lag("open", back).over(w)
        for back in range(1, step):
            chain = chain & (F.lag("kind", back).over(w) == "text")
        parts.append(F.when((F.col("kind") == "text") & chain, F.lag("region_id", step).over(w)))
    return rows.withColumn("caption_id", F.coalesce(*parts)).where("caption_id IS NOT NULL").select("paper_id", "region_id", "caption_id")


def nth_spans(mentions: DataFrame) -> DataFrame:
    """Adds ``nth``: how often the span's key came in its sentence before it, from 1 (W14). ``mentions``: text_id, key, start."""
    return mentions.withColumn("nth", F.row_number().over(Window.partitionBy("text_id", "key").orderBy("start")).cast("long"))


def renumbered(rows: DataFrame, key: str, order: str, name: str = "new_id") -> DataFrame:
    """Adds dense ids from 1 per paper in reading order."""
    return rows.withColumn(name, F.dense_rank().over(Window.partitionBy("paper_id").orderBy(order, key)).cast("long"))


def remapped(rows: DataFrame, column: str, ids: DataFrame, key: str, name: str = "new_id") -> DataFrame:
    """``rows`` with ``column`` renumbered by ``ids``; references to rows that are not there become null."""
    table = ids.select("paper_id", F.col(key).alias(column), F.col(name).alias("__new")).distinct()
    return rows.join(table, ["paper_id", column], "left").withColumn(column, F.col("__new")).drop("__new")


EDGE = {"overlap": 0.2, "gap": 500.0, "same_page": 3.0, "next_page": 0.8, "per_overlap": 3.0, "near": 2.0, "per_gap": 250.0, "base": 0.3, "between": 0.75, "numbered": 1.5, "equal": 2.5, "other": 1.0, "margin": 0.25}


def caption_edges(captions: DataFrame, floats: DataFrame, *keep: str) -> DataFrame:
    """Scored candidate pairs of captions and floats of one kind, at most a page apart, that overlap sideways and lie near.

    Both: paper_id, id, kind, page, number, x0, y0, x1, y1 (page units). Pages are matched by an equi-join on the neighbours. Columns
    ``keep`` of both come along as c_* and f_*.
    """
    c = captions.select("paper_id", "kind", F.col("id").alias("caption_id"), F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("at"), *(F.col(n).alias(f"c_{n}") for n in ("page", "number", "x0", "y0", "x1", "y1", *keep)))
    f = floats.select("paper_id", "kind", F.col("id").alias("float_id"), F.col("page").alias("at"), *(F.col(n).alias(f"f_{n}") for n in ("number", "x0", "y0", "x1", "y1", *keep)))
    both = c.join(f, ["paper_id", "kind", "at"])
    width = F.least("c_x1", "f_x1") - F.greatest("c_x0", "f_x0")
    overlap = F.greatest(F.lit(0.0), width / F.greatest(F.lit(1e-9), F.least(F.col("c_x1") - F.col("c_x0"), F.col("f_x1") - F.col("f_x0"))))
    gap = F.greatest(F.lit(0.0), F.greatest(F.col("c_y0") - F.col("f_y1"), F.col("f_y0") - F.col("c_y1")))
    same = F.col("at") == F.col("c_page")
    gap = F.when(same, gap).otherwise(F.lit(EDGE["gap"]))
    score = F.when(same, EDGE["same_page"]).otherwise(EDGE["next_page"]) + EDGE["per_overlap"] * overlap + F.greatest(F.lit(0.0), EDGE["near"] - gap / EDGE["per_gap"]) + EDGE["base"]
    known = F.col("c_number").isNotNull()
    score = score + F.when(known, EDGE["numbered"]).otherwise(0.0) + F.when(known & (F.col("c_number") == F.col("f_number")), EDGE["equal"]).when(known & F.col("f_number").isNotNull(), -EDGE["other"]).otherwise(0.0)
    return both.where((overlap >= EDGE["overlap"]) & (gap <= EDGE["gap"])).select("paper_id", "kind", "caption_id", "float_id", F.round(score, 6).alias("score"), *(f"{s}_{n}" for s in "cf" for n in keep))


#: Scores are taken to six places, as whole numbers, so that sums are exact; a pair without an edge costs more than any way around it.
_UNIT, _NEVER, _FAR = 10**6, 1 << 50, 1 << 62


class _Flow:
    """Cheapest way to bring the supply of rows to the need of columns, whose sums are equal: shortest augmenting paths over
    potentials, by which each unit of flow costs nothing and all else nothing or more."""

    def __init__(self, costs, supply, need):
        import numpy as np

        self.np, self.costs, self.need = np, costs, need.copy()
        self.u, self.v, self.flow = np.zeros(len(supply), np.int64), costs.min(axis=0), np.zeros(costs.shape, np.int64)
        for row, left in enumerate(supply):
            while left:
                left -= self._push(row, int(left))

    def _reach(self, row: int, ends, stop: int = _FAR, without: int | None = None):
        """Nearest column of ``ends`` from ``row`` by way of columns and, against the flow, rows; none if it is ``stop`` or more away.

        ``without`` is a column that ``row`` cannot go to at once. Gives the column with the rows and columns passed.
        """
        np = self.np
        far, before, settled = np.full(len(self.v), _FAR), np.full(len(self.v), -1), np.zeros(len(self.v), bool)
        rows, fresh = {row: (0, None)}, [row]
        while True:
            for r in fresh:
                line = self.costs[r] - self.u[r] - self.v + rows[r][0]
                if without is not None and r == row:
                    line[without] = _FAR
                nearer = ~settled & (line < far)
                far[nearer], before[nearer] = line[nearer], r
            at = int(np.where(settled, _FAR, far).argmin())
            if far[at] >= stop:
                return None
            settled[at] = True
            if ends[at]:
                return at, far, before, settled, rows
            fresh = [r for r in map(int, np.flatnonzero(self.flow[:, at])) if r not in rows]
            rows.update((r, (int(far[at]), at)) for r in fresh)

    def _push(self, row: int, most: int) -> int:
        at, far, before, settled, rows = self._reach(row, self.need > 0)
        way, column = [], at
        while column is not None:
            r = int(before[column])
            way.append((r, column, rows[r][1]))
            column = rows[r][1]
        amount = min([most, int(self.need[at]), *(int(self.flow[r, back]) for r, _, back in way if back is not None)])
        for r, to, back in way:
            self.flow[r, to] += amount
            if back is not None:
                self.flow[r, back] -= amount
        self.need[at] -= amount
        for r, (base, _) in rows.items():
            self.u[r] += far[at] - base
        self.v[settled] -= far[at] - far[settled]
        return amount

    def needed(self, row: int, column: int, margin: int) -> bool:
        """Whether the whole loses ``margin`` at least without the single unit from ``row`` to ``column``."""
        return self._reach(row, self.np.arange(len(self.v)) == column, margin, column) is None


def _components(edges: dict) -> list[list[tuple]]:
    """Edges (left, right) parted into those that hang together."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        parent[root((0, a))] = root((1, b))
    parts: dict = {}
    for a, b in edges:
        parts.setdefault(root((0, a)), []).append((a, b))
    return list(parts.values())


def _assigned(edges: list[tuple], lefts: dict, rights: dict, margin: float | None):
    """Pairs of a one-to-one assignment of greatest weight; ``lefts`` and ``rights`` tell how many there are of a name, else it is one.

    With ``margin`` only pairs of single names that cannot be given up for less. Of names that are alike in all edges each can take
    the other's place, so pairs of several never are such; a component without single names on both sides is not solved.
    """
    import numpy as np

    weight: dict = {}
    for a, b, score in edges:
        w = round(score * _UNIT)
        if w > weight.get((a, b), 0):
            weight[a, b] = w
    for part in _components(weight):
        if margin is not None and not any(lefts.get(a, 1) == 1 == rights.get(b, 1) for a, b in part):
            continue
        rows, columns = ({x: i for i, x in enumerate(sorted({e[k] for e in part}))} for k in (0, 1))
        # The last row and column stand for none.
        costs = np.full((len(rows) + 1, len(columns) + 1), _NEVER)
        costs[-1], costs[:, -1] = 0, 0
        for a, b in part:
            costs[rows[a], columns[b]] = -weight[a, b]
        supply, need = np.array([lefts.get(x, 1) for x in rows]), np.array([rights.get(x, 1) for x in columns])
        solved = _Flow(costs, [*supply, need.sum()], np.array([*need, supply.sum()]))
        for a, b in part:
            if solved.flow[rows[a], columns[b]] and (margin is None or lefts.get(a, 1) == 1 == rights.get(b, 1) and solved.needed(rows[a], columns[b], round(margin * _UNIT))):
                yield a, b, weight[a, b]


def _heaviest(edges: list[tuple]) -> tuple[float, set]:
    """Total and pairs of a one-to-one assignment of greatest weight; leaving a name unassigned weighs 0."""
    pairs = list(_assigned(edges, {}, {}, None))
    return sum(w for _, _, w in pairs) / _UNIT, {(a, b) for a, b, _ in pairs}


def assign(edges: list[tuple], margin: float = EDGE["margin"], lefts: dict = {}, rights: dict = {}) -> list[tuple]:  # noqa: B006
    """One-to-one pairs of the greatest total weight from (left, right, score) edges, without those that can be given up for less
    than ``margin`` of the total. ``lefts`` and ``rights``: of how many that are alike a name is the first, else it stands alone."""
    return sorted((a, b) for a, b, _ in _assigned(edges, lefts, rights, margin))


def captions_to_floats(captions: DataFrame, floats: DataFrame) -> DataFrame:
    """paper_id, kind, caption_id, float_id: the assignment of greatest weight per paper and kind, abstaining where it is close.

    Captions, and floats, that lie on one place with one number are alike: they are assigned as one name of that many, and of them
    none is told. Of several rows of an id the first by place counts.
    """
    place = ("page", "number", "x0", "y0", "x1", "y1")

    def alike(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("paper_id", "kind", "id").agg(F.min(F.struct(*place)).alias("at"))
        return one.groupBy("paper_id", "kind", "at").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")).select("paper_id", "kind", "id", "at.*", "size")

    def run(pdf):
        import pandas as pd

        sizes = (dict(zip(pdf[f"{side}_id"], pdf[size])) for side, size in (("caption", "c_size"), ("float", "f_size")))
        got = assign(list(zip(pdf["caption_id"], pdf["float_id"], pdf["score"])), EDGE["margin"], *sizes)
        return pd.DataFrame([(pdf["paper_id"].iloc[0], pdf["kind"].iloc[0], a, b) for a, b in got], columns=["paper_id", "kind", "caption_id", "float_id"])

    c, f = alike(captions), alike(floats)
    for side in (c, f):
        single = side.where("size = 1").select("paper_id", "kind").distinct()
        c = c.join(single, ["paper_id", "kind"], "left_semi")
    edges = caption_edges(c, f, "size")
    kinds = dict(edges.dtypes)
    return edges.groupBy("paper_id", "kind").applyInPandas(run, ", ".join(f"{x} {kinds[x]}" for x in ("paper_id", "kind", "caption_id", "float_id")))


def outline_headings(outline: DataFrame, headings: DataFrame, pages: int = 1, least: float = 0.8) -> DataFrame:
    """paper_id, entry_id, section_id, similarity (J10): the heading most like an outline's entry within ``pages`` pages of it.

    Titles are compared once a page, however many entries and headings there have them; those of too different lengths are not.
    """
    o = outline.select("paper_id", "entry_id", F.lower(F.trim("title")).alias("a"), "page")
    asked = o.select("paper_id", "page", "a").distinct().withColumn("at", F.explode(F.sequence(F.col("page") - pages, F.col("page") + pages)))
    h = headings.select("paper_id", "section_id", F.lower(F.trim("header")).alias("b"), F.col("page").alias("at")).groupBy("paper_id", "at", "b").agg(F.min("section_id").alias("section_id"))
    longest = F.greatest(F.length("a"), F.length("b"))
    like = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("a", "b") / longest)
    near = F.abs(F.length("a") - F.length("b")) <= (1 - least) * longest + 1e-6 * longest
    rows = asked.join(h, ["paper_id", "at"]).where(near).withColumn("similarity", F.round(like, 6)).where(F.col("similarity") >= least)
    found = rows.groupBy("paper_id", "page", "a").agg(F.max(F.struct("similarity", (-F.col("section_id")).alias("less"))).alias("f"))
    best = o.join(found, ["paper_id", "page", "a"]).select("paper_id", "entry_id", "f.*").groupBy("paper_id", "entry_id").agg(F.max(F.struct("similarity", "less")).alias("b"))
    return best.select("paper_id", "entry_id", (-F.col("b.less")).alias("section_id"), "b.similarity")


def covered_chars(links: DataFrame, chars: DataFrame, cell: int = 50) -> DataFrame:
    """link_id, char_id (J17): characters whose centre lies in a link's rectangle, by an equi-join on page and grid cells.

    ``links``: link_id, page_id, x0, y0, x1, y1; ``chars``: char_id, page_id, x, y.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    spread = links.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    placed = chars.select("page_id", "char_id", "x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    hit = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return spread.join(placed, ["page_id", "gx", "gy"]).where(hit).select("link_id", "char_id")


def covered_counts(links: DataFrame, chars: DataFrame) -> DataFrame:
    """link_id, n (J17): of how many characters ``covered_chars`` has a row. Equal rectangles of a page are asked once, and equal
    places of characters are met once, with their number; links without characters have no row."""
    at, box = ("page_id", "x", "y"), ("page_id", "x0", "y0", "x1", "y1")
    places = chars.groupBy(*at).agg(F.count(F.lit(1)).alias("k")).withColumn("char_id", F.col("k"))
    boxes = links.select(*box).distinct().withColumn("link_id", F.struct(*box))
    found = covered_chars(boxes, places).groupBy("link_id").agg(F.sum("char_id").alias("n")).select("link_id.*", "n")
    return links.join(found, list(box)).groupBy("link_id").agg(F.sum("n").alias("n"))


def free_spans(spans: DataFrame) -> DataFrame:
    """Spans (key, start, stop, priority) that no span of an earlier priority overlaps (J18); of one priority all stay."""
    a, b = spans.alias("a"), spans.select("key", "start", "stop", "priority").alias("b")
    overlap = (F.col("a.key") == F.col("b.key")) & (F.col("b.priority") < F.col("a.priority")) & (F.col("b.start") < F.col("a.stop")) & (F.col("a.start") < F.col("b.stop"))
    return a.join(b, overlap, "left_anti")


def merged_panels(figures: DataFrame) -> DataFrame:
    """paper_id, figure_id, merged_id (T20): panels ``2a``, ``2b`` of a page are one figure, named by the first of them."""
    stem = F.regexp_extract(F.lower(F.coalesce("label", F.lit(""))), r"^(s?\d+)[a-z]?$", 1)
    group = F.when(stem != "", F.concat_ws("/", stem, F.col("page").cast("string"))).otherwise(F.concat(F.lit("#"), F.col("figure_id").cast("string")))
    return figures.select("paper_id", "figure_id", F.min("figure_id").over(Window.partitionBy("paper_id", group)).alias("merged_id"))


def own_regions(regions: DataFrame) -> DataFrame:
    """Regions of the scan's own article (T26): from the first title's on, up to a title of another article behind it.

    ``regions``: paper_id, region_id (reading order), kind, text. A scan without a title keeps all.
    """
    w = Window.partitionBy("paper_id").orderBy("region_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = regions.withColumn("titles", F.sum((F.col("kind") == "title").cast("int")).over(w)).withColumn("any", F.max("titles").over(Window.partitionBy("paper_id")))
    return rows.where("titles = 1 OR any = 0").drop("titles", "any")


def page_classes(pages: DataFrame) -> DataFrame:
    """paper_id, page, class (A21): blank, figure, references, table or text by what a page's regions hold.

    ``pages``: paper_id, page, n_chars, n_figures, n_tables, n_entries.
    """
    kind = F.when(F.coalesce("n_chars", F.lit(0)) + F.coalesce("n_figures", F.lit(0)) + F.coalesce("n_tables", F.lit(0)) == 0, "blank").when(F.col("n_entries") >= 5, "references").when((F.col("n_figures") > 0) & (F.col("n_chars") < 400), "figure").when((F.col("n_tables") > 0) & (F.col("n_chars") < 800), "table").otherwise("text")
    return pages.select("paper_id", "page", kind.alias("class"))


def weighted_medians(runs: DataFrame) -> DataFrame:
    """page_id, size, weight (A27): the median font size by characters, and the weight that most characters have, ties to the smaller."""
    size = runs.groupBy("page_id", "size").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("page_id").orderBy("size")
    upto = size.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy("page_id")))
    middle = upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("page_id").agg(F.min("size").alias("size"))
    weight = runs.groupBy("page_id", "weight").agg(F.sum("n").alias("n")).groupBy("page_id").agg(F.max(F.struct("n", (-F.col("weight")).alias("less"))).alias("b"))
    return middle.join(weight.select("page_id", (-F.col("b.less")).alias("weight")), "page_id")


def kept_boxes(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes that no box of a higher score on their page covers by ``least`` of their common area (T36); ties to the smaller id.

    ``boxes``: page_id, box_id, score, x0, y0, x1, y1.
    """
    cols = ("box_id", "score", "x0", "y0", "x1", "y1")
    a, b = boxes.alias("a"), boxes.select("page_id", *(F.col(c).alias(f"o_{c}") for c in cols)).alias("b")
    area = lambda x0, y0, x1, y1: (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))
    common = F.greatest(F.lit(0), F.least("x1", "o_x1") - F.greatest("x0", "o_x0")) * F.greatest(F.lit(0), F.least("y1", "o_y1") - F.greatest("y0", "o_y0"))
    union = area("x0", "y0", "x1", "y1") + area("o_x0", "o_y0", "o_x1", "o_y1") - common
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_box_id") < F.col("box_id")))
    return a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & better & (common >= least * union), "left_anti")


def paged(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in a stated order: ``limit`` rows behind the first ``offset``."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def ordered_distinct(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first come: value, place from 1."""
    first = rows.groupBy(column).agg(F.min(order).alias("first"))
    return first.select(column, "first")


def candidate_union(*tiers: DataFrame) -> DataFrame:
    """Candidates (text_id, bib_id, confidence) of several tiers: of repeats the earliest tier's stays."""
    rows = None
    for i, t in enumerate(tiers):
        one = t.select("text_id", "bib_id", "confidence", F.lit(i).alias("tier"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("text_id", "bib_id").agg(F.min_by("confidence", "tier").alias("confidence"), F.min("tier").cast("long").alias("tier"))
    return best


def unless_blank(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def decided(values: DataFrame, key: str, field: str, producers: tuple[str, ...]) -> DataFrame:
    """key, value, rule (T14): the first producer in order that gives a value that is not blank; the rule names it.

    ``values`` has one column per producer.
    """
    value, rule = F.coalesce(*(unless_blank(F.col(p)) for p in producers)), F.coalesce(*(F.when(unless_blank(F.col(p)).isNotNull(), F.lit(p)) for p in producers))
    return values.select(key, value.alias(field), rule.alias("rule"))
