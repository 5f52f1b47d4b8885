"""Word and box operators. Windows partition by printed page or table, which bounds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass import vocab
from tradeglass.functions import evidence
from tradeglass.functions.text import add, contains_any, one_of, rx
from tradeglass.operators.skew import grouped_rank
from tradeglass.session import checkpoint

PAGE = ["doc_id", "page"]
LEFT, UPTO = Window.unboundedPreceding, Window.currentRow


def text_rows(words: DataFrame) -> DataFrame:
    """Words to text rows: a row breaks where centres are more than max(4.5, 0.85 height) apart.

    Neighbouring centres are compared in reading order, in place of a running row mean.
    """
    w = Window.partitionBy(*PAGE).orderBy("cy", "x", "word_no")
    c = add(words, {"cy": "y + height / 2"})
    brk = F.expr("cast(coalesce(cy - before > greatest(4.5, 0.85 * height), true) AS int)")
    rows = c.withColumn("before", F.lag("cy").over(w)).withColumn(
        "row_no", F.sum(brk).over(w.rowsBetween(LEFT, UPTO)).cast("int"))
    return rows.groupBy(*PAGE, "row_no").agg(
        F.count("*").cast("int").alias("n_words"),
        F.expr("array_join(transform(array_sort(collect_list(struct(x, word_no, word))), w -> w.word), ' ') AS text"))


def columns(blocks: DataFrame, gap: float = 18.0) -> DataFrame:
    """Column positions of a page: x positions split at gaps, mean per cluster."""
    w = Window.partitionBy(*PAGE).orderBy("x")
    xs = blocks.groupBy(*PAGE, "x").agg(F.count("*").alias("n"))
    brk = F.expr(f"cast(coalesce(x - before > {gap}, true) AS int)")
    c = xs.withColumn("before", F.lag("x").over(w)).withColumn(
        "col_no", F.sum(brk).over(w.rowsBetween(LEFT, UPTO)).cast("int"))
    return c.groupBy(*PAGE, "col_no").agg(F.expr("sum(x * n) / sum(n) AS col_x"))


def nearest_column(blocks: DataFrame, cols: DataFrame) -> DataFrame:
    """Column nearest to each block; a page has a handful of columns, carried as one array per page."""
    anchors = cols.groupBy(*PAGE).agg(F.expr("collect_list(struct(col_x, col_no)) AS cols"))
    near = "array_min(transform(cols, c -> struct(abs(c.col_x - x) AS d, c.col_no AS n))).n"
    return blocks.join(anchors, PAGE).selectExpr(*blocks.columns, f"{near} AS col_no")


def table_kind(tables: DataFrame) -> DataFrame:
    """grid, keyValue or table from the header row and column count, with parse concerns.

    tables: key columns, header array<string>, n_columns, n_rows.
    """
    months = ", ".join(f"'{m.lower()}'" for m in vocab.MONTHS)
    cells = "filter(transform(header, c -> lower(trim(c))), c -> c <> '')"
    grid = (f"(size({cells}) >= 5 AND {cells}[0] = 'year' AND size(filter({cells}, c -> c IN ({months}))) >= 4)")
    t = add(tables, {"kind": f"CASE WHEN {grid} THEN 'grid' WHEN n_columns IN (2, 4) THEN 'keyValue' ELSE 'table' END"})
    concerns = ("array_compact(array(if(n_rows <= 1 AND kind <> 'keyValue', 'short_table', NULL), "
                "if(n_columns <= 1, 'insufficient_columns', NULL)))")
    return add(t, {"concerns": f"array_join({concerns}, ',')"})


def phrase_matches(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """Token sequences (or one compact word) of an anchor on the pages of its report, all with their position on the page.

    Pages emit n-grams only for the lengths their report's anchors have, and join on
    the whole phrase, so a common first token pairs with nothing. A gram carries its box instead of its words.
    """
    a = add(anchors, {"n": "size(tokens)", "phrase": "array_join(tokens, ' ')", "compact": "array_join(transform(tokens, t -> regexp_replace(t, '[^a-z0-9]', '')), '')"})
    lens = a.groupBy("doc_id").agg(F.expr("collect_set(n) AS lens"))
    pages = words.groupBy(*PAGE).agg(F.expr(
        "array_sort(collect_list(struct(line_no, word_no, token, x, y, width, height))) AS ws"))
    grams = pages.join(lens, "doc_id").selectExpr(
        *PAGE, "explode(flatten(transform(lens, n -> if(size(ws) >= n, transform(sequence(0, size(ws) - n), "
        "i -> struct(i AS pos, n AS n, slice(ws, i + 1, n) AS span)), array())))) AS g")
    right, low = "array_max(transform(g.span, w -> w.x + w.width))", "array_max(transform(g.span, w -> w.y + w.height))"
    grams = grams.selectExpr(*PAGE, "g.n AS n", "array_join(g.span.token, ' ') AS phrase", "g.span[0].line_no AS line_no", "array_min(g.span.x) AS x", "array_min(g.span.y) AS y",
                             f"{right} - array_min(g.span.x) AS width", f"{low} - array_min(g.span.y) AS height")
    boxed = grams.join(a.select("doc_id", "anchor_id", "n", "phrase"), ["doc_id", "n", "phrase"]).select(*PAGE, "anchor_id", "line_no", "x", "y", "width", "height")
    one = add(words, {"compact": "regexp_replace(token, '[^a-z0-9]', '')"}).join(
        a.where("n > 1").select("doc_id", "anchor_id", "compact"), ["doc_id", "compact"]).selectExpr(
        *PAGE, "anchor_id", "line_no", "x", "y", "width", "height")
    unique = boxed.unionByName(one).groupBy(*PAGE, "anchor_id", "x", "y", "width", "height").agg(
        F.min("line_no").alias("line_no"))
    w = Window.partitionBy(*PAGE, "anchor_id").orderBy("line_no", "x", "y", "width", "height")
    return unique.withColumn("position", F.row_number().over(w).cast("long"))


def box_clusters(boxes: DataFrame, dx: float, dy: float) -> DataFrame:
    """Connected groups of boxes that touch once grown by the margins, labelled by their smallest id.

    Boxes meet only inside shared cells of a grid, and only distinct rectangles take
    part. Each round takes the least label among a box's neighbours and then the label of that label,
    so chains shrink by doubling; rounds are checkpointed and end when no label changes.
    """
    rect = ["x", "y", "width", "height"]
    b = boxes.groupBy(*PAGE, *rect).agg(F.min("box_id").alias("box_id"))
    cells = ("flatten(transform(sequence(cast(floor(x / 100) AS int), cast(floor((x + width + {dx}) / 100) AS int)), i -> "
             "transform(sequence(cast(floor(y / 50) AS int), cast(floor((y + height + {dy}) / 50) AS int)), j -> struct(i, j))))").format(dx=dx, dy=dy)
    placed = b.selectExpr(*PAGE, "box_id", f"struct({', '.join(rect)}) AS box", f"explode({cells}) AS cell")
    other = placed.selectExpr(*PAGE, "cell", "box_id AS other_id", "box AS other")
    near = placed.join(other, [*PAGE, "cell"]).where(f"box_id < other_id AND {evidence.boxes_close('box', 'other', str(dx), str(dy))}")
    half = near.select("box_id", "other_id").distinct()
    edges = checkpoint(half.unionByName(half.selectExpr("other_id AS box_id", "box_id AS other_id")))
    labels = checkpoint(b.selectExpr(*PAGE, *rect, "box_id", "box_id AS cluster_id"))
    while True:
        best = edges.join(labels.selectExpr("box_id AS other_id", "cluster_id AS seen"), "other_id").groupBy("box_id").agg(
            F.min("seen").alias("seen"))
        near = labels.join(best, "box_id", "left").selectExpr(
            *PAGE, *rect, "box_id", "cluster_id AS old", "least(cluster_id, coalesce(seen, cluster_id)) AS near")
        jump = labels.selectExpr("box_id AS near", "cluster_id AS far")
        nxt = checkpoint(near.join(jump, "near").selectExpr(
            *PAGE, *rect, "box_id", "least(near, far) AS cluster_id", "least(near, far) < old AS moved"))
        moved = nxt.where("moved").limit(1).count()
        labels = nxt.drop("moved")
        if not moved:
            return boxes.join(labels, [*PAGE, *rect]).select(boxes["box_id"], *PAGE, *rect, "cluster_id", *[
                c for c in boxes.columns if c not in {"box_id", *PAGE, *rect}])


def ranked_clusters(clustered: DataFrame) -> DataFrame:
    """All clusters of a document, placed by anchor weight, distinct anchors and confidence."""
    scored = clustered.groupBy("doc_id", "page", "cluster_id").agg(F.expr(
        "sum(weight * confidence) + count(DISTINCT anchor_id) * 0.75 + count(DISTINCT if(kind <> 'identity', anchor_id, NULL)) * 1.5 "
        "+ avg(confidence) AS score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "cluster_id")
    return scored.withColumn("position", F.row_number().over(w).cast("long"))


def distinct_highlights(boxes: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """One box per rectangle rounded to the tolerance; identity boxes are not drawn."""
    rounded = {f"r_{c}": f"round({c} / {tolerance})" for c in ("x", "y", "width", "height")}
    drawn = add(boxes.where("kind <> 'identity'"), rounded)
    return drawn.groupBy(*PAGE, *rounded).agg(F.min("box_id").alias("box_id")).select(*PAGE, "box_id")


def distinct_slides(slides: DataFrame) -> DataFrame:
    """First slide per (finding, page, label, rectangles)."""
    return slides.groupBy("finding_id", "page", "label", "rects").agg(F.min("slide_no").alias("slide_no"))


def export_grade(boxes: DataFrame) -> DataFrame:
    """A bundle is export grade when every box has point geometry from a trusted source."""
    good = f"has_points AND {one_of('source', vocab.EXPORT_SOURCES)}"
    return boxes.groupBy("finding_id").agg(F.expr(f"bool_and({good}) AS export_grade"))


def bundle_status(bundles: DataFrame) -> DataFrame:
    """ready or unresolved from slide, anchor and cluster counts of a finding."""
    substantive = "n_substantive >= 2 OR (localizable AND n_substantive > 0)"
    status = (
        "CASE WHEN n_slides = 0 AND n_clusters = 0 THEN 'unresolved' "
        f"WHEN n_required > 0 AND n_required_matched = 0 THEN if(n_slides > 0 OR {substantive}, 'ready', 'unresolved') "
        "WHEN n_slides = 0 AND n_substantive = 0 THEN 'unresolved' "
        "WHEN n_slides = 0 AND NOT multi_anchor AND n_substantive < 2 AND NOT localizable THEN 'unresolved' ELSE 'ready' END")
    return add(bundles, {"status": status})


def manifest(bundles: DataFrame) -> DataFrame:
    """Counts of ready, unresolved, blocking and exportable findings per report."""
    return bundles.groupBy("report_id").agg(
        F.count("*").cast("int").alias("n_findings"),
        F.expr("cast(count_if(status = 'ready') AS int) AS n_ready"),
        F.expr("cast(count_if(status <> 'ready') AS int) AS n_unresolved"),
        F.expr("cast(count_if(status <> 'ready' AND canonical) AS int) AS n_blocking"),
        F.expr("cast(count_if(status = 'ready' AND export_grade) AS int) AS n_exportable"))


def exhibits(items: DataFrame, style: str = "letter") -> DataFrame:
    """Exhibit numbers of selected findings in their order, across tasks."""
    from tradeglass.functions.text import exhibit_label
    return add(grouped_rank(items, ["report_id"], ["ord"], "position"), {"exhibit": exhibit_label("position", style)})


def box_exhibits(boxes: DataFrame, numbered: DataFrame) -> DataFrame:
    """Each drawn rectangle (in whole pixels) with the labels of the exhibits that cite it, in the order of the exhibits.

    boxes: report_id, finding_id, page, x, y, width, height, kind; numbered: report_id, finding_id, position, exhibit. A label
    stands once; identity boxes are not drawn. Repeats are folded before a rectangle's labels are gathered.
    """
    rect = [f"cast({c} AS int) AS {c}" for c in ("x", "y", "width", "height")]
    key = ["report_id", "page", "x", "y", "width", "height"]
    drawn = boxes.where("kind <> 'identity'").selectExpr("report_id", "finding_id", "page", *rect).distinct()
    cited = drawn.join(numbered.select("report_id", "finding_id", "position", "exhibit"), ["report_id", "finding_id"])
    first = cited.groupBy(*key, "exhibit").agg(F.min("position").alias("position"))
    return first.groupBy(*key).agg(F.expr("transform(array_sort(collect_list(struct(position, exhibit))), e -> e.exhibit) AS exhibits"))


def keyword_pages(pages: DataFrame, words: list[str], neighbours: bool = True) -> DataFrame:
    """Pages that mention a keyword, all pages of a document when none does, plus their neighbours."""
    p = add(pages, {"hit": contains_any("lower(page_text)", words)})
    stats = p.groupBy("doc_id").agg(F.expr("max(hit) AS any_hit"), F.max("page").alias("last_page"))
    chosen = p.join(stats, "doc_id").where("hit OR NOT any_hit")
    around = "sequence(greatest(page - 1, 1), least(page + 1, last_page))" if neighbours else "array(page)"
    return chosen.selectExpr("doc_id", f"explode({around}) AS page").distinct()


def section_range(pages: DataFrame, start: str, end: str) -> DataFrame:
    """Contiguous pages from the first start heading up to the first later page with an end heading."""
    s = pages.where(f"page_text RLIKE {rx(start)}").groupBy("doc_id").agg(F.min("page").alias("first_page"))
    e = pages.where(f"page_text RLIKE {rx(end)}").select("doc_id", F.col("page").alias("end_page")).join(s, "doc_id").where(
        "end_page > first_page").groupBy("doc_id").agg(F.min("end_page").alias("end_page"))
    return pages.select("doc_id", "page").join(s, "doc_id").join(e, "doc_id", "left").where(
        "page >= first_page AND page < coalesce(end_page, page + 1)").select("doc_id", "page")


def page_quality(pages: DataFrame) -> DataFrame:
    """Text quality from length, table quality from account words and dollar amounts."""
    words = rx(r"(?i)account\s+type|revolving|installment|mortgage")
    money = rx(r"\$\s*\d")
    return pages.selectExpr(
        "doc_id", "page", "least(length(page_text) / 1800.0D, 1.0D) AS text_quality",
        f"least(if(page_text RLIKE {words}, 1.0D, 0.0D) + if(page_text RLIKE {money}, 0.3D, 0.0D), 1.0D) AS table_quality")


def entity_sections(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows between a heading and the next heading or stop row, numbered per document.

    rows: key, page, row_no, is_heading, is_stop. Documents are split into pages first:
    headings are counted per page, page totals are summed over the few page rows, and the
    two add up, so no window ever spans more than one page of text.
    """
    marks = add(rows, {"mark": "cast(is_heading OR is_stop AS int)"})
    page_key = [*key, "page"]
    totals = marks.groupBy(*page_key).agg(
        F.sum("mark").alias("marks"), F.sum(F.col("is_heading").cast("int")).alias("heads"),
        F.expr("max_by(is_heading, if(mark = 1, row_no, NULL)) AS closing"))
    earlier = Window.partitionBy(*key).orderBy("page").rowsBetween(LEFT, -1)
    carried = totals.withColumns({
        "before_heads": F.coalesce(F.sum("heads").over(earlier), F.lit(0)),
        "open_before": F.coalesce(F.last("closing", ignorenulls=True).over(earlier), F.lit(False)),
    }).select(*page_key, "before_heads", "open_before")
    w = Window.partitionBy(*page_key).orderBy("row_no").rowsBetween(LEFT, UPTO)
    local = marks.withColumns({
        "heads": F.sum(F.col("is_heading").cast("int")).over(w),
        "last_mark": F.last(F.expr("if(mark = 1, is_heading, NULL)"), ignorenulls=True).over(w),
    })
    return local.join(carried, page_key).where("coalesce(last_mark, open_before)").selectExpr(
        *key, "page", "row_no", "cast(before_heads + heads AS int) AS section_no")


def continuation_entries(rows: DataFrame) -> DataFrame:
    """Forward-fill the section mode of a page and attach continuation lines to the entry above."""
    w = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(LEFT, UPTO)
    filled = rows.withColumns({
        "section_mode": F.last("mode", ignorenulls=True).over(w),
        "entry_no": F.sum(F.col("starts").cast("int")).over(w).cast("int"),
    }).where("entry_no > 0")
    return filled.groupBy(*PAGE, "entry_no").agg(
        F.expr("min_by(section_mode, line_no) AS section_mode"), F.count("*").cast("int").alias("n_lines"),
        F.expr("array_join(transform(array_sort(collect_list(struct(line_no, body))), r -> r.body), ' ') AS body"))


def lanes(words: DataFrame, split_x: float) -> DataFrame:
    """Text of the left and the right lane of every line."""
    side = add(words, {"lane": f"if(x < {split_x}, 'left', 'right')"})
    return side.groupBy(*PAGE, "line_no", "lane").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(x, word_no, word))), w -> w.word), ' ') AS text"))


def search_anchors(candidates: DataFrame) -> DataFrame:
    """Anchors of a finding: same kind and tokens merge to the largest weight and any required flag."""
    strong = candidates.where(f"NOT {evidence.low_signal('text')}")
    tokens = add(strong, {"tokens": f"array_join(regexp_extract_all(lower(text), {rx('[a-z0-9$%./:#-]+')}, 0), ' ')"})
    return tokens.where("tokens <> ''").groupBy("finding_id", "kind", "tokens").agg(
        F.max("weight").alias("weight"), F.expr("bool_or(required) AS required"))
