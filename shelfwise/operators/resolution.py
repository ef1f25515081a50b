"""Conservative entity resolution: alias, exact, then trigram similarity with a clear winner.

Work is done once per distinct normalised name. Trigram candidates come from an
inverted index over prefixes: with Jaccard >= t two sets must share one of their
n - ceil(t*n) + 1 rarest trigrams, so common trigrams are never join keys for
names that have rarer ones, and no name meets a name it cannot match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..config import FUZZY_AUTO, FUZZY_MARGIN, FUZZY_REVIEW
from ..functions.text import entity_key, trigrams
from ..sources.staging import shuffle_width


#: Names that one join key of the trigram index holds at most, about.
INDEX_ROWS = 1_000


def _prefixes(names: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(scope, norm, grams, size, place, gram, df): a row for each of a name's rarest trigrams that another name knows; ``grams`` holds all, rarest first."""
    counted = names.select("scope", "norm", F.explode(trigrams("norm")).alias("gram")).join(frequency, ["scope", "gram"], "left")
    ranked = counted.groupBy("scope", "norm").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("ranked"))
    keep = (F.size("ranked") - F.ceil(F.size("ranked") * threshold - 1e-9) + 1).cast("int")
    rows = ranked.select("scope", "norm", F.transform("ranked", lambda g: g["gram"]).alias("grams"), F.size("ranked").alias("size"), F.posexplode(F.slice("ranked", F.lit(1), keep)).alias("place", "g"))
    return rows.select("scope", "norm", "grams", "size", "place", "g.gram", "g.df").filter(F.col("df") > 0)


def trigram_candidates(queries: DataFrame, dim: DataFrame, *, threshold: float = FUZZY_REVIEW, index_rows: int = INDEX_ROWS) -> DataFrame:
    """All (scope, norm, dim_norm, sim) with sim >= threshold. Both inputs: scope, norm; they are made distinct here.

    A trigram that many names hold is dealt into parts of about ``index_rows`` names, and the index to the session's
    width of tasks, as its work is in the pairs and not in its bytes. A pair counts at the rarest trigram it shares, so none comes twice.
    """
    width = shuffle_width(queries)
    names = lambda df: df.select("scope", "norm").filter(F.length("norm") > 0).distinct().repartition(width, "scope", "norm")
    q, d = names(queries), names(dim)
    frequency = d.select("scope", F.explode(trigrams("norm")).alias("gram")).groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("df"))
    parts, key = F.ceil(F.col("df") / F.lit(index_rows)).cast("int"), ["scope", "gram", "part"]
    left = _prefixes(q, frequency, threshold).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("df")
    right = _prefixes(d, frequency, threshold).select(
        "scope", "gram", F.pmod(F.xxhash64("norm"), parts).cast("int").alias("part"), *[F.col(c).alias(f"dim_{c}") for c in ("norm", "grams", "size", "place")])
    near = (F.col("dim_size") >= F.col("size") * threshold - 1e-9) & (F.col("size") >= F.col("dim_size") * threshold - 1e-9)
    # nothing before the rarest shared trigram is shared, so what stands after it bounds what is
    at_most, needed = F.least(F.col("size") - F.col("place"), F.col("dim_size") - F.col("dim_place")), (F.col("size") + F.col("dim_size")) * (threshold / (1 + threshold))
    met = left.repartition(width, *key).join(right.repartition(width, *key), key).filter(near & (at_most >= needed - 1e-6))
    shared = F.array_intersect("grams", "dim_grams")
    n = F.size(shared).cast("double")
    # the count alone turns most pairs away; a filter on it first works a pair out once
    return met.filter(n >= needed - 1e-6).filter(F.get(shared, F.lit(0)) == F.col("gram")).select(
        "scope", "norm", "dim_norm", (n / (F.col("size") + F.col("dim_size") - n)).alias("sim")).filter(F.col("sim") >= threshold)


def best_two(candidates: DataFrame, dim: DataFrame) -> DataFrame:
    """Per query: best entity with its similarity, and the runner-up's similarity. ``dim``: scope, norm, entity_id."""
    # of the entities of one name only the first two can be among the best two
    first = dim.select("scope", F.col("norm").alias("dim_norm"), "entity_id").withColumn(
        "place", F.row_number().over(W.partitionBy("scope", "dim_norm").orderBy("entity_id"))).filter(F.col("place") <= 2).drop("place")
    named = candidates.join(first, ["scope", "dim_norm"])
    order = W.partitionBy("scope", "norm").orderBy(F.col("sim").desc(), "entity_id")
    # the rank filter runs before the shuffle, so only two candidates per task travel
    two = named.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2)
    return two.groupBy("scope", "norm").agg(
        F.max(F.when(F.col("place") == 1, F.col("sim"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("entity_id"))).alias("candidate_id"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("sim"))), F.lit(0.0)).alias("second"))


def _id_type(dim: DataFrame, column: str) -> str:
    """Type of the ids in an outcome: whole numbers as bigint, any other id (a text, say) as it is."""
    kind = dim.schema[column].dataType
    return "bigint" if isinstance(kind, T.IntegralType) else kind.simpleString()


def _outcomes(kind: str) -> Callable[..., Column]:
    """Builder of an outcome whose ids are of type ``kind``."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)

    def outcome(status: str | Column, method: str | Column, entity: Column, candidate: Column, confidence: Column) -> Column:
        return F.struct(as_col(status).alias("status"), as_col(method).alias("method"), entity.cast(kind).alias("entity_id"),
                        candidate.cast(kind).alias("candidate_id"), confidence.cast("double").alias("confidence"))

    return outcome


def resolve_names(norms: DataFrame, dim: DataFrame, aliases: DataFrame, *, unmatched: str = "UNRESOLVED", auto: float = FUZZY_AUTO,
                  review: float = FUZZY_REVIEW, margin: float = FUZZY_MARGIN) -> DataFrame:
    """Outcome per normalised name.

    ``norms``: norm. ``dim``: entity_id, norm. ``aliases``: norm, alias_entity_id,
    alias_confidence. ``unmatched`` is the status when nothing is similar enough
    (brands go to REVIEW, retailers and products are UNRESOLVED).
    """
    null, _outcome = F.lit(None), _outcomes(_id_type(dim, "entity_id"))
    keys = norms.select("norm").distinct()
    known = dim.groupBy("norm").agg(F.min("entity_id").alias("exact_id"))
    alias = aliases.groupBy("norm").agg(F.min_by(F.struct("alias_entity_id", "alias_confidence"), "alias_entity_id").alias("a")).select("norm", "a.*")
    present = dim.select(F.col("entity_id").alias("alias_entity_id"), F.lit(True).alias("alias_present")).distinct()
    df = keys.join(alias, "norm", "left").join(present, "alias_entity_id", "left").join(known, "norm", "left")
    open_keys = df.filter(F.col("alias_entity_id").isNull() & F.col("exact_id").isNull() & (F.length("norm") > 0)).select(
        F.lit("*").alias("scope"), "norm")
    scoped = dim.select(F.lit("*").alias("scope"), "norm", "entity_id")
    fuzzy = best_two(trigram_candidates(open_keys, scoped, threshold=review), scoped).drop("scope")
    df = df.join(fuzzy, "norm", "left")
    clear = (F.col("best") >= auto) & (F.col("best") - F.col("second") >= margin)
    outcome = (
        F.when(F.col("alias_present"), _outcome("RESOLVED", "MAPPING", F.col("alias_entity_id"), null, F.coalesce("alias_confidence", F.lit(1.0))))
        .when(F.col("alias_entity_id").isNotNull(), _outcome("REVIEW", "MAPPING", null, F.col("alias_entity_id"), F.lit(0.0)))
        .when(F.col("exact_id").isNotNull(), _outcome("RESOLVED", "NORMALIZED", F.col("exact_id"), null, F.lit(1.0)))
        .when(clear, _outcome("RESOLVED", "FUZZY", F.col("candidate_id"), null, F.col("best")))
        .when(F.col("best").isNotNull(), _outcome("REVIEW", "FUZZY", null, F.col("candidate_id"), F.col("best")))
        .otherwise(_outcome(unmatched, "FUZZY" if unmatched == "REVIEW" else "NONE", null, null, F.lit(0.0))))
    return df.select("norm", outcome.alias("o"), "best", "second").select("norm", "o.*", "best", "second")


def resolve_retailers(items: DataFrame, retailers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the outcome for ``retailer`` text; a missing text is UNRESOLVED."""
    df = items.withColumn("norm", entity_key("retailer_text"))
    dim = retailers.select(F.col("retailer_id").alias("entity_id"), entity_key("name").alias("norm"))
    return df.join(resolve_names(df.filter("norm <> ''"), dim, aliases), "norm", "left").withColumns({
        "status": F.coalesce("status", F.lit("UNRESOLVED")), "method": F.coalesce("method", F.lit("NONE")),
        "confidence": F.coalesce("confidence", F.lit(0.0))})


def resolve_brands(items: DataFrame, brands: DataFrame, aliases: DataFrame) -> DataFrame:
    """Brand by its text, else by the product text; the competitor follows the resolved brand."""
    df = items.withColumn("norm", entity_key(F.coalesce(F.when(F.length("brand_text") > 0, F.col("brand_text")), F.col("product_text"))))
    dim = brands.select(F.col("brand_id").alias("entity_id"), entity_key("name").alias("norm"))
    df = df.join(resolve_names(df.filter("norm <> ''"), dim, aliases, unmatched="REVIEW"), "norm", "left").withColumns({
        "status": F.coalesce("status", F.lit("UNRESOLVED")), "method": F.coalesce("method", F.lit("NONE")),
        "confidence": F.coalesce("confidence", F.lit(0.0))})
    owners = brands.select(F.col("brand_id").alias("entity_id"), F.col("competitor_id").alias("owner_id"))
    df = df.join(owners, "entity_id", "left")
    owner_status = (F.when(F.col("status") == "UNRESOLVED", "UNRESOLVED").when((F.col("status") == "RESOLVED") & F.col("owner_id").isNotNull(), "RESOLVED")
                    .otherwise("REVIEW"))
    return df.withColumn("competitor_status", owner_status)


def resolve_products(items: DataFrame, products: DataFrame, aliases: DataFrame, *, auto: float = FUZZY_AUTO, review: float = FUZZY_REVIEW,
                     margin: float = FUZZY_MARGIN) -> DataFrame:
    """Product inside its resolved brand: alias, barcode, SKU, exact name, then trigrams.

    ``items``: item_id, product_text, brand_id, sku, barcode, pack_size.
    ``products``: product_id, brand_id, name, sku, barcode, pack_label. A hit whose
    stated pack contradicts the canonical pack goes to review.
    """
    null, _outcome = F.lit(None), _outcomes(_id_type(products, "product_id"))
    df = items.withColumns({"norm": entity_key("product_text"), "pack_norm": entity_key("pack_size")})
    p = products.select("product_id", F.col("brand_id").alias("p_brand"), entity_key("name").alias("p_norm"), F.trim("sku").alias("p_sku"),
                        F.trim("barcode").alias("p_barcode"), entity_key("pack_label").alias("p_pack"))
    first = lambda key, name: p.filter(F.col(key).isNotNull()).groupBy("p_brand", key).agg(
        F.min_by(F.struct(F.col("product_id").alias("id"), F.col("p_pack").alias("pack")), "product_id").alias(name))
    alias = aliases.groupBy("norm").agg(F.min("alias_entity_id").alias("alias_id"), F.max("alias_confidence").alias("alias_confidence"))
    target = p.select(F.col("product_id").alias("alias_id"), F.struct(F.col("product_id").alias("id"), F.col("p_pack").alias("pack"),
                                                                       F.col("p_brand").alias("brand")).alias("by_alias"))
    df = df.join(alias, "norm", "left").join(target, "alias_id", "left")
    for key, column, name in (("p_barcode", F.trim("barcode"), "by_barcode"), ("p_sku", F.trim("sku"), "by_sku"), ("p_norm", F.col("norm"), "by_name")):
        table = first(key, name)
        df = df.join(table, (df["brand_id"] == table["p_brand"]) & (column == table[key]), "left").drop("p_brand", key)
    settled = F.coalesce(F.col("by_alias.id"), F.col("by_barcode.id"), F.col("by_sku.id"), F.col("by_name.id"))
    open_items = df.filter(settled.isNull() & F.col("brand_id").isNotNull() & (F.col("norm") != "")).select(
        F.col("brand_id").cast("string").alias("scope"), "norm")
    dim = p.select(F.col("p_brand").cast("string").alias("scope"), F.col("p_norm").alias("norm"), F.col("product_id").alias("entity_id"), "p_pack")
    two = best_two(trigram_candidates(open_items, dim, threshold=review), dim)
    packs = dim.select(F.col("entity_id").alias("candidate_id"), F.col("p_pack").alias("candidate_pack"))
    two = two.join(packs, "candidate_id", "left").select(F.col("scope").cast(items.schema["brand_id"].dataType).alias("brand_id"), "norm", "best", "second", "candidate_id", "candidate_pack")
    df = df.join(two, ["brand_id", "norm"], "left")
    clash = lambda pack: (F.col("pack_norm") != "") & F.coalesce(pack != "", F.lit(False)) & (F.col("pack_norm") != pack)

    def hit(name: str, method: str, confidence: Column) -> Column:
        h = F.col(name)
        return F.when(clash(h["pack"]), _outcome("REVIEW", method, null, h["id"], confidence)).otherwise(
            _outcome("RESOLVED", method, h["id"], null, confidence))

    one = F.lit(1.0)
    sure = F.coalesce("alias_confidence", one)
    clear = (F.col("best") >= auto) & (F.col("best") - F.col("second") >= margin)
    outcome = (
        F.when(F.length(F.trim(F.coalesce("product_text", F.lit("")))) == 0, _outcome("UNRESOLVED", "NONE", null, null, F.lit(0.0)))
        .when(F.col("brand_id").isNull(), _outcome("REVIEW", "DEPENDENT", null, null, F.lit(0.0)))
        .when(F.col("by_alias").isNotNull() & (F.col("by_alias.brand") != F.col("brand_id")), _outcome("REVIEW", "MAPPING", null, F.col("by_alias.id"), sure))
        .when(F.col("by_alias").isNotNull(), hit("by_alias", "MAPPING", sure))
        .when(F.col("by_barcode").isNotNull(), hit("by_barcode", "BARCODE", one)).when(F.col("by_sku").isNotNull(), hit("by_sku", "SKU", one))
        .when(F.col("by_name").isNotNull(), hit("by_name", "NORMALIZED", one))
        .when(clear & ~clash(F.col("candidate_pack")), _outcome("RESOLVED", "FUZZY", F.col("candidate_id"), null, F.col("best")))
        .when(F.col("best").isNotNull(), _outcome("REVIEW", "FUZZY", null, F.col("candidate_id"), F.col("best")))
        .otherwise(_outcome("UNRESOLVED", "NONE", null, null, F.lit(0.0))))
    return df.select("item_id", outcome.alias("o")).select("item_id", "o.*")


def review_rows(outcomes: DataFrame, pending: DataFrame) -> DataFrame:
    """Review items to open. ``outcomes``: observation_id, entity_type, source_value, status, method, candidate_id, confidence."""
    stated = F.length(F.trim(F.coalesce("source_value", F.lit("")))) > 0
    need = outcomes.filter((F.col("status") != "RESOLVED") & (stated | (F.col("status") != "UNRESOLVED")))
    label = F.when(stated, F.trim("source_value")).otherwise("(missing)")
    reason = F.concat(F.lit("Source value '"), label, F.lit("': Entity resolution status: "), F.col("status"), F.lit("; method="), F.col("method"))
    fresh = need.join(pending.filter(F.col("status") == "PENDING").select("observation_id", "entity_type").distinct(), ["observation_id", "entity_type"], "left_anti")
    return fresh.select("observation_id", "entity_type", "candidate_id", "confidence", F.when(F.col("status") == "REVIEW", 2).otherwise(1).alias("priority"),
                        F.lit("PENDING").alias("status"), reason.alias("reason"))


def review_worklist(queue: DataFrame, *, status: str = "PENDING", limit: int | None = None) -> DataFrame:
    """All items of a status, most urgent first; ``limit`` is a page size."""
    df = queue.filter(F.col("status") == status).orderBy(F.col("priority").desc(), F.col("created_at").desc(), "review_id")
    return df if limit is None else df.limit(limit)


def review_backlog(queue: DataFrame) -> DataFrame:
    pending = F.col("status") == "PENDING"
    df = queue.agg(F.count(F.when(pending, 1)).alias("pending"), F.count(F.when(pending & (F.col("entity_type") == "CONFLICT"), 1)).alias("conflicts"))
    severity = F.when((F.col("conflicts") > 0) | (F.col("pending") > 50), "WARN").when(F.col("pending") == 0, "PASS").otherwise("INFO")
    return df.withColumn("severity", severity)


def open_conflicts(queue: DataFrame) -> DataFrame:
    """Promotions that stay hidden: those with a pending conflict."""
    return queue.filter((F.col("entity_type") == "CONFLICT") & (F.col("status") == "PENDING")).groupBy("promotion_id").agg(
        F.count(F.lit(1)).alias("open_conflicts"))


def re_resolve(promotions: DataFrame, newest: DataFrame, brands: DataFrame, retailers: DataFrame, brand_aliases: DataFrame,
               retailer_aliases: DataFrame) -> DataFrame:
    """Retry promotions with a missing brand, competitor or retailer from their newest observation.

    ``newest``: promotion_id, brand_text, product_text, retailer_text. When the
    brand text fails, the first word (three letters or more) of the product is tried.
    """
    open_rows = promotions.filter(F.col("brand_id").isNull() | F.col("competitor_id").isNull() | F.col("retailer_id").isNull())
    df = open_rows.join(newest, "promotion_id", "left")
    texts = df.select("promotion_id", "brand_text", "product_text")
    by_text = resolve_brands(texts, brands, brand_aliases).select("promotion_id", F.when(F.col("status") == "RESOLVED", F.col("entity_id")).alias("b1"), F.col("owner_id").alias("o1"))
    word = F.regexp_extract(F.trim("product_text"), r"^(\S+)", 1)
    words = texts.select("promotion_id", F.when(F.length(word) >= 3, word).alias("brand_text"), F.lit(None).cast("string").alias("product_text"))
    by_word = resolve_brands(words, brands, brand_aliases).select("promotion_id", F.when(F.col("status") == "RESOLVED", F.col("entity_id")).alias("b2"), F.col("owner_id").alias("o2"))
    shops = resolve_retailers(df.select("promotion_id", "retailer_text"), retailers, retailer_aliases).select(
        "promotion_id", F.when(F.col("status") == "RESOLVED", F.col("entity_id")).alias("r1"))
    out = df.select("promotion_id", "brand_id", "competitor_id", "retailer_id").join(by_text, "promotion_id").join(by_word, "promotion_id").join(shops, "promotion_id")
    needs = F.col("brand_id").isNull() | F.col("competitor_id").isNull()
    brand, owner = F.coalesce("b1", "b2"), F.when(F.col("b1").isNotNull(), F.col("o1")).otherwise(F.col("o2"))
    return out.select("promotion_id", F.when(needs & brand.isNotNull(), brand).otherwise(F.col("brand_id")).alias("brand_id"),
                      F.when(needs & owner.isNotNull(), owner).otherwise(F.col("competitor_id")).alias("competitor_id"),
                      F.coalesce("retailer_id", "r1").alias("retailer_id"))


def close_resolved_reviews(queue: DataFrame, promotions: DataFrame) -> DataFrame:
    """Pending brand / competitor / retailer items whose promotion is resolved by now become APPROVED."""
    done = promotions.filter(F.col("brand_id").isNotNull() & F.col("competitor_id").isNotNull()).select(
        "promotion_id", F.col("retailer_id").isNotNull().alias("_shop"), F.lit(True).alias("_done"))
    df = queue.join(done, "promotion_id", "left")
    ok = (F.col("status") == "PENDING") & F.col("_done") & (F.col("entity_type").isin("BRAND", "COMPETITOR") | ((F.col("entity_type") == "RETAILER") & F.col("_shop")))
    return df.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "APPROVED").otherwise(F.col("status"))).drop("_shop", "_done")


