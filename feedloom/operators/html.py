"""Pages as element tables: selectors, list extraction, headline links."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions.dates import parse_date
from feedloom.functions.markup import scan_batches
from feedloom.functions.text import WS, blank_to_null, utf16_left, utf16_length
from feedloom.functions.urls import with_absolute_link
from feedloom.operators.joins import spread_small
from feedloom.schemas import HEADINGS, MAX_PAGE_BYTES, MAX_PAGE_ITEMS, MAX_SELECTOR, MAX_SUMMARY, MAX_TITLE, META_CHARS, NODES, RULE
from feedloom.session import bound_batches

ROLES = ("item", "title", "link", "date", "summary")


#: The limits a poll sets to what one scrape may bring.
SCRAPE_LIMITS = {"max_items": MAX_PAGE_ITEMS, "max_title": MAX_TITLE, "max_summary": MAX_SUMMARY}
#: And to what it may read: bytes of a page, and characters that are searched for its charset. A poll has no limit unless it is given one.
READER_LIMITS = {**SCRAPE_LIMITS, "max_bytes": MAX_PAGE_BYTES, "meta_chars": META_CHARS}


def html_nodes(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Every element of every page (``page_id, url, html``). With ``max_bytes`` larger pages become error rows unread."""
    bound_batches(pages.sparkSession)
    fits = F.lit(True) if max_bytes is None else F.coalesce(F.octet_length("html") <= max_bytes, F.lit(True))
    error = F.when(~fits, "page is over the scrape limit")
    checked = pages.select("page_id", "url", F.when(fits, F.col("html")).alias("html"), error.alias("error"))
    return spread_small(checked, "page_id").mapInArrow(scan_batches, NODES)


# --- selectors

# Selector work is written as SQL text: the same predicate is built for every role and step, and one parsed string
# costs the driver far less than dozens of column calls.

_TOKEN = r"^[a-zA-Z][\w-]*|\.[\w-]+|#[\w-]+|\[[^\]]+\]"
_PAIR = r"""^\[([\w-]+)(?:=["\x27]?([^"\x27]*)["\x27]?)?\]$"""


def selector(text: str) -> Column:
    """The steps of the selector in column ``text``, outermost first; null where it does not parse. Descendant steps
    only: ``div.card``, ``.card h3``, ``a[rel="bookmark"]``, ``#main .row``."""
    clean = rf"regexp_replace({text}, r'^[{WS}]+|[{WS}]+$', '')"
    parts = rf"split({clean}, r'[{WS}]+')"
    tokens = f"transform({parts}, p -> regexp_extract_all(p, r'{_TOKEN}', 0))"
    step = f"""named_struct(
      'tag', lower(get(filter(ts, t -> t rlike '^[a-zA-Z]'), 0)),
      'id', substring(try_element_at(filter(ts, t -> startswith(t, '#')), -1), 2),
      'classes', transform(filter(ts, t -> startswith(t, '.')), t -> substring(t, 2)),
      'attrs', transform(filter(ts, t -> startswith(t, '[')), t -> named_struct(
        'name', lower(regexp_extract(t, r'{_PAIR}', 1)),
        'value', if(contains(t, '='), regexp_extract(t, r'{_PAIR}', 2), null))))"""
    return F.expr(f"""get(transform(array({tokens}), tokens -> case when {clean} <> ''
      and forall(zip_with({parts}, tokens, (p, ts) -> array_join(ts, '') = p), ok -> ok)
      and forall(flatten(tokens), t -> not startswith(t, '[') or t rlike r'{_PAIR}')
      then transform(tokens, ts -> {step}) end), 0)""")


def _matches(step: str) -> str:
    return f"""coalesce(({step}.tag is null or tag = {step}.tag) and ({step}.id is null or coalesce(id = {step}.id, false))
      and forall({step}.classes, c -> array_contains(classes, c))
      and forall({step}.attrs, a -> map_contains_key(attrs, a.name)
        and (a.value is null or try_element_at(attrs, a.name) = a.value)), false)"""


def matches(chain: str, step: int) -> Column:
    """Whether the element row satisfies one step of the chain in column ``chain``."""
    return F.expr(_matches(f"get({chain}, {step})")) & (F.size(chain) > step)


def _any_step(chain: str) -> Column:
    return F.expr(f"coalesce(exists({chain}, s -> {_matches('s')}), false)")


def with_matches(rows: DataFrame, chains: dict[str, str], steps: int, scope: list[str]) -> DataFrame:
    """Flag the elements that end each selector chain (flag name to chain column) inside ``scope``.

    Element extents nest, so an element lies inside an earlier match exactly when the furthest end among earlier
    matches is past its start: each step is one running maximum over the page in document order, never a join.
    """
    earlier = Window.partitionBy(*scope).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{out}_0": F.coalesce(matches(chain, 0), F.lit(False)) for out, chain in chains.items()})
    for j in range(1, steps):
        inside = {f"{out}_{j}": F.max(F.when(F.col(f"{out}_{j - 1}"), F.col("end"))).over(earlier) for out in chains}
        rows = rows.withColumns(inside).withColumns({
            f"{out}_{j}": F.coalesce(F.col(f"{out}_{j}") > F.col("start"), F.lit(False)) & F.coalesce(matches(chain, j), F.lit(False))
            for out, chain in chains.items()})
    hits = {}
    for out, chain in chains.items():
        hit = F.lit(False)
        for j in range(steps):
            hit = F.when(F.size(chain) == j + 1, F.col(f"{out}_{j}")).otherwise(hit)
        hits[out] = hit
    return rows.withColumns(hits).drop(*[f"{out}_{j}" for out in chains for j in range(steps)])


def select_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Elements of every page that match one selector."""
    steps = len(text.split())
    chained = nodes.filter("error is null").withColumn("_text", F.lit(text)).withColumn("_chain", selector("_text"))
    return with_matches(chained, {"_hit": "_chain"}, steps, ["page_id"]).filter("_hit").drop("_text", "_chain", "_hit")


# --- rules

def with_rule(df: DataFrame, json: str, out: str = "rule") -> DataFrame:
    """Rule text to a rule, null for anything unusable: five known keys, selector texts of at most 200 characters."""
    read = df.withColumn("_v", F.expr(f"try_parse_json({json})")).withColumns({
        f"_{k}": F.expr(f"case when schema_of_variant(try_variant_get(_v, '$.{k}', 'variant')) = 'STRING' "
                        f"then try_variant_get(_v, '$.{k}', 'string') end") for k in ROLES})
    kind = lambda k: F.expr(f"coalesce(schema_of_variant(try_variant_get(_v, '$.{k}', 'variant')), 'VOID')")
    text = lambda k: F.col(f"_{k}")
    usable = lambda k: (kind(k) == "VOID") | (text(k) == "") | (
        (utf16_length(text(k)) <= MAX_SELECTOR) & selector(f"_{k}").isNotNull())
    ok = F.expr("coalesce(startswith(schema_of_variant(_v), 'OBJECT'), false)") & (text("item") != "")
    for k in ROLES:
        ok = ok & F.coalesce(usable(k), F.lit(False))
    rule = F.struct(*[blank_to_null(text(k)).alias(k) for k in ROLES])
    return read.withColumn(out, F.when(ok, rule)).drop("_v", *[f"_{k}" for k in ROLES])


def literal_rule(**selectors: str) -> Column:
    return F.struct(*[F.lit(selectors.get(k)).cast("string").alias(k) for k in ROLES]).cast(RULE)


# --- extraction

def _text_pool(prefix: str = "") -> Column:
    """Rank of a linked text: not opening with a digit, then any text, then none."""
    return F.when(F.col("text_len") == 0, 3).when(F.col("text").rlike("^[0-9]"), 2).otherwise(1)


def headline_order(title: Column) -> Column:
    """Sort key of the anchors of a block, the headline first: the first one inside the title element, else the
    longest text that does not open with a digit, else the longest text, else the first anchor."""
    in_title = F.coalesce((F.col("start") >= title["start"]) & (F.col("end") <= title["end"]), F.lit(False))
    pool = F.when(in_title, 0).otherwise(_text_pool())
    length = F.when(pool.isin(1, 2), -F.col("text_len")).otherwise(0)
    return F.struct(pool.alias("pool"), length.alias("length"), F.col("start"))


def is_link() -> Column:
    return (F.col("tag") == "a") & (F.coalesce(F.try_element_at("attrs", F.lit("href")), F.lit("")) != "")


def extract_items(nodes: DataFrame, rules: DataFrame | Column, steps: int | None = None, max_items: int | None = None,
                  max_title: int | None = None, max_summary: int | None = None) -> DataFrame:
    """What each rule finds on its pages: ``page_id, rule_id, pos, guid, url, title, summary, published_at``.

    ``rules`` is one rule for every page, or holds ``page_id, rule_id, rule``; ``steps`` is the longest selector's step count where it is known. Elements that can play no part in a rule are dropped before the one
    shuffle, which is by page; containers, their contents and every chosen element then come from running maxima and
    one aggregate over the same ordering. A group is one page's useful elements. The ``max_`` arguments are a poll's limits:
    blocks of a page, and lengths of titles and summaries.
    """
    chain = [selector(f"rule.{r}").alias(f"c_{r}") for r in ROLES]
    most = F.greatest(*[F.size(f"c_{r}") for r in ROLES]).alias("n")
    read = nodes.filter("error is null")
    if isinstance(rules, Column):
        one = nodes.sparkSession.range(1).select(rules.alias("rule"))
        steps = steps or one.select(*chain).select(most).first()[0]
        ruled = read.withColumn("rule", rules).select("*", F.lit(0).alias("rule_id"), *chain)
    else:
        chains = rules.select("page_id", "rule_id", *chain)
        steps = steps or chains.select(most).agg(F.max("n")).first()[0]
        ruled = read.join(chains, "page_id")
    longest = steps or 1
    keep = ["page_id", "rule_id", "base_url", "tag", "id", "classes", "attrs", "start", "end", "text", "text_len"]
    heading = F.col("tag").isin(HEADINGS)
    useful = is_link() | (heading & F.col("c_title").isNull())
    for role in ROLES:
        useful = useful | _any_step(f"c_{role}")
    rows = ruled.filter(useful).select(
        *keep, *[f"c_{r}" for r in ROLES])

    scope = ["page_id", "rule_id"]
    order = Window.partitionBy(*scope).orderBy("start")
    rows = with_matches(rows, {"is_item": "c_item"}, longest, scope)
    before = F.max(F.when(F.col("is_item"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before).withColumn(
        "opens", F.col("is_item") & (F.col("_before").isNull() | (F.col("start") >= F.col("_before"))))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.count_if("opens").over(upto)).withColumn(
        "until", F.max(F.when(F.col("opens"), F.col("end"))).over(upto))
    wanted = F.col("pos") >= 1 if max_items is None else F.col("pos").between(1, max_items)
    inside = rows.filter(wanted & ~F.col("opens") & (F.col("start") < F.col("until")))

    block = [*scope, "pos"]
    inside = with_matches(inside, {f"is_{r}": f"c_{r}" for r in ROLES if r != "item"}, longest, block)
    titled = F.col("is_title") | (F.col("c_title").isNull() & heading)
    title = F.min(F.when(titled, F.struct("start", "end", "text"))).over(Window.partitionBy(*block))
    inside = inside.withColumn("title_el", title)
    link_el = F.struct(F.try_element_at("attrs", F.lit("href")).alias("href"), F.col("base_url"))
    attr = lambda name: blank_to_null(F.try_element_at("attrs", F.lit(name)))
    date_el = F.coalesce(attr("datetime"), attr("content"), F.col("text"))
    first = lambda flag, value: F.min_by(F.when(flag, value), F.when(flag, F.col("start")))
    found = inside.groupBy(*block).agg(
        F.first("title_el").alias("title_el"), F.max("base_url").alias("page_url"),
        F.min_by(F.when(is_link(), F.struct(link_el.alias("el"), "text")),
                 F.when(is_link(), headline_order(F.col("title_el")))).alias("headline"),
        first(F.col("is_link"), link_el).alias("link_el"),
        first(F.col("is_date"), date_el).alias("date_text"),
        first(F.col("is_summary"), F.col("text")).alias("summary"))
    href = F.when(F.col("link_el").isNotNull(), F.col("link_el.href")).otherwise(F.col("headline.el.href"))
    shown = F.coalesce("title_el.text", "headline.text", F.lit(""))
    return with_absolute_link(found, href, F.col("page_url")).filter("url is not null").select(
        *block, F.col("url").alias("guid"), "url", (shown if max_title is None else utf16_left(shown, max_title)).alias("title"),
        blank_to_null(F.col("summary") if max_summary is None else utf16_left(F.col("summary"), max_summary)).alias("summary"),
        parse_date(F.col("date_text")).alias("published_at"))


def headline_links(nodes: DataFrame, container: str) -> DataFrame:
    """The headline anchor of every block matching ``container``."""
    return extract_items(nodes, literal_rule(item=container), len(container.split())).select(
        "page_id", "pos", "url", "title")
