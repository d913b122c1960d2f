"""Rule suggestion: for pages that publish no feed, guess how their lists are built."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions.text import utf16_length
from feedloom.operators.html import extract_items, headline_order, html_nodes, is_link
from feedloom.schemas import HEADINGS
from feedloom.session import stored

# What makes a group of same-shaped siblings a candidate, and how many suggestions and samples are kept.
MIN_MEMBERS, MIN_LINKED, MIN_TEXT = 3, 2, 8
TOP_RULES, SAMPLE = 3, 5


def signature() -> Column:
    classes = F.array_join(F.array_sort("classes"), ".")
    return F.when(F.size("classes") > 0, F.concat("tag", F.lit("."), classes)).otherwise(F.col("tag"))


def selector_for(el: Column, parent: Column) -> Column:
    """A selector for an element from what it and its parent carry."""
    first = lambda c: F.get(c, F.lit(0))
    return (F.when(F.size(el["classes"]) > 0, F.concat(F.lit("."), F.array_join(el["classes"], ".")))
            .when(el["id"].isNotNull() & (el["id"] != ""), F.concat(F.lit("#"), el["id"]))
            .when(F.size(parent["classes"]) > 0, F.concat(F.lit("."), first(parent["classes"]), F.lit(" "), el["tag"]))
            .when(parent["id"].isNotNull() & (parent["id"] != ""), F.concat(F.lit("#"), parent["id"], F.lit(" "), el["tag"]))
            .otherwise(el["tag"]))


def candidate_blocks(nodes: DataFrame) -> DataFrame:
    """Groups of same-shaped siblings that read as a list, one per page and selector, in page order.

    Each carries its selector and its model, the first member with a link and some text. Only group leaders meet
    their parents, so the self join is over few rows.
    """
    read = nodes.filter("error is null").select("page_id", "node_id", "parent_id", "tag", "id", "classes", "start",
                                                "end", "text_len", "links")
    linked = (F.col("links") > 0) & (F.col("text_len") >= MIN_TEXT)
    extent = F.struct("start", "end")
    groups = read.groupBy("page_id", "parent_id", signature().alias("sig")).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(linked).alias("linked"),
        F.min(F.struct("node_id", "tag", "id", "classes")).alias("first"),
        F.min(F.when(linked, extent)).alias("model"),
    ).filter((F.col("members") >= MIN_MEMBERS) & (F.col("linked") >= MIN_LINKED))
    parents = read.select("page_id", F.col("node_id").alias("parent_id"), F.struct("id", "classes").alias("parent"))
    sited = groups.join(parents, ["page_id", "parent_id"], "left")
    chosen = sited.withColumn("item", selector_for(F.col("first"), F.col("parent")))
    # A selector met twice on a page counts where it is met first.
    place = F.struct("parent_id", F.col("first.node_id").alias("node_id"))
    return chosen.groupBy("page_id", "item").agg(F.min(place).alias("place"), F.min_by("model", place).alias("model"))


def within_blocks(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every element once for each block whose model it starts inside of, with the block's columns.

    A sweep over a page: models open and close, and a running sum tells how many are open at an element. Extents nest, so
    the open model of depth d is the last one of that depth that opened. A row per element and open block is all that is
    made; no element meets a block it lies outside of.
    """
    parts = [c for c in elements.columns if c != "page_id"]
    given = [c for c in blocks.columns if c != "page_id"]
    # At one place a model closes before an element is looked at, and opens after the element it is.
    closes, looks, opens = F.lit(0), F.lit(1), F.lit(2)
    no_element = F.lit(None).cast(elements.select(F.struct(*parts).alias("e")).schema["e"].dataType)
    no_block = F.lit(None).cast(blocks.select(F.struct(*given).alias("b")).schema["b"].dataType)
    edge = lambda kind, at, step: F.struct(kind.alias("kind"), F.col(at).alias("at"), F.lit(step).alias("step"))
    edges = blocks.select("page_id", F.struct(*given).alias("block"), F.explode(F.array(
        edge(opens, "model.start", 1), edge(closes, "model.end", -1))).alias("edge")).select(
        "page_id", "edge.*", no_element.alias("element"), F.when(F.col("edge.step") == 1, F.col("block")).alias("block"))
    looked = elements.select("page_id", looks.alias("kind"), F.col("start").alias("at"), F.lit(0).alias("step"),
                             F.struct(*parts).alias("element"), no_block.alias("block"))
    sweep = Window.partitionBy("page_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = looked.unionByName(edges).withColumn("open", F.sum("step").over(sweep).cast("int")).filter(
        (F.col("open") > 0) & (F.col("kind") != closes))
    depths = F.when(F.col("kind") == opens, F.array("open")).otherwise(F.sequence(F.lit(1), F.col("open")))
    level = Window.partitionBy("page_id", "depth").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    handed = met.withColumn("depth", F.explode(depths)).withColumn("block", F.last("block", ignorenulls=True).over(level))
    return handed.filter(F.col("kind") == looks).select("page_id", "element.*", "block.*")


def suggested_rules(nodes: DataFrame) -> DataFrame:
    """``page_id, rule_id, rule, place``: a rule per candidate, filled in from its model's descendants."""
    blocks = candidate_blocks(nodes).withColumn("rule_id", F.col("place.node_id"))
    useful = nodes.filter("error is null").filter(F.col("tag").isin(*HEADINGS, "a", "time", "p") | (F.size("classes") > 0))
    # Of texts the first character counts, of classes the first, of attributes the link.
    slim = useful.select("page_id", "tag", F.slice("classes", 1, 1).alias("classes"), F.map_filter(
        "attrs", lambda name, _: name == "href").alias("attrs"), "start", "end", F.left("text", F.lit(1)).alias("text"), "text_len")
    inside = within_blocks(slim, blocks)
    key = ["page_id", "rule_id"]
    model = Window.partitionBy(*key)
    extent = lambda *more: F.struct("start", "end", *more)
    heading = F.min(F.when(F.col("tag").isin(HEADINGS), extent("tag"))).over(model)
    inside = inside.withColumn("heading", heading)
    anchor = F.min_by(F.when(is_link(), extent("classes")),
                      F.when(is_link(), headline_order(F.col("heading")))).over(model)
    inside = inside.withColumn("anchor", anchor)
    encloses = ((F.size("classes") > 0) & (F.col("start") < F.col("anchor.start"))
                & (F.col("end") >= F.col("anchor.end")))
    wrapper = F.min(F.when(encloses, F.struct((F.col("end") - F.col("start")).alias("span"), F.col("start"),
                                              F.get("classes", F.lit(0)).alias("class"))))
    para = F.min(F.when(F.col("tag") == "p", F.struct("start", F.get("classes", F.lit(0)).alias("class"))))
    picked = inside.groupBy(*key).agg(
        F.first("place").alias("place"), F.first("item").alias("item"), F.first("heading").alias("heading"),
        F.first("anchor").alias("anchor"), wrapper.alias("wrapper"), para.alias("para"),
        F.max(F.col("tag") == "time").alias("dated"))
    first_class = F.get("anchor.classes", F.lit(0))
    in_heading = (F.col("anchor.start") >= F.col("heading.start")) & (F.col("anchor.end") <= F.col("heading.end"))
    link = (F.when(in_heading, F.concat("heading.tag", F.lit(" a")))
            .when(F.col("wrapper").isNotNull(), F.concat(F.lit("."), "wrapper.class", F.lit(" a")))
            .when(first_class.isNotNull(), F.concat(F.lit("a."), first_class)))
    summary = F.when(F.col("para").isNotNull(), F.coalesce(F.concat(F.lit("."), "para.class"), F.lit("p")))
    return picked.select(*key, F.struct(
        "item", F.col("heading.tag").alias("title"), F.when(F.col("anchor").isNotNull(), link).alias("link"),
        F.when(F.col("dated"), "time").alias("date"), summary.alias("summary")).alias("rule"), "place")


def suggest_rules(nodes: DataFrame, top: int = TOP_RULES, sample: int = SAMPLE, **limits) -> DataFrame:
    """The best rules of every page with what they would bring: long titles first, many items second.

    The element rows are read several times and so should be a stored table; the rules are stored here. A suggested
    selector has at most two steps. ``limits`` are those of ``extract_items``.
    """
    rules = stored(suggested_rules(nodes))
    found = extract_items(nodes, rules.select("page_id", "rule_id", "rule"), steps=2, **limits)
    entry = F.struct("pos", "url", "title", "summary", "published_at")
    scored = found.groupBy("page_id", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(utf16_length(F.col("title"))).alias("avg_title"),
        F.slice(F.array_sort(F.collect_list(entry)), 1, sample).alias("sample")).filter("n >= 2")
    score = F.least(F.col("avg_title"), F.lit(80.0)) * F.log2(F.col("n") + 1)
    best = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "place")
    return (scored.withColumn("score", score).join(rules, ["page_id", "rule_id"])
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("page_id", "rank", "rule", "n", "score", "sample"))


def scrape_preview(pages: DataFrame, max_bytes: int | None = None, **limits) -> DataFrame:
    """For every requested page its suggestions, or the reason there are none. Pages over ``max_bytes`` are not read."""
    nodes = stored(html_nodes(pages, max_bytes))
    errors = nodes.filter("error is not null").select("page_id", "error")
    asked = pages.select("page_id", "url").join(errors, "page_id", "left")
    shown = asked.join(suggest_rules(nodes, **limits), "page_id", "left")
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("the page could not be read as a list: "), "error")).when(
        F.col("rank").isNull(), "nothing on the page reads as a list of articles (a repeated block of linked headlines)")
    return shown.select("page_id", "url", "rank", "rule", "n", "sample", reason.alias("reason"))
