"""URL filter: listed host rules first, mined association rules for every other address."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from premia.llm.common import stored

# The listed rules (host, path, verdict). A rule holds for its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
# Host labels and path words that are told apart by their place; the others count without it.
LABELS = 4
SEGMENTS = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case, else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(longest):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of an address: scheme, all host labels, all path words, query keys.

    The last ``LABELS`` labels and first ``SEGMENTS`` path words are told apart by their place, so that a
    combination names a part of the web and not just words; those beyond count wherever they stand. Digits in a
    path read as one sign.
    """
    labels = F.reverse(F.split(host, r"\."))
    words = F.filter(F.split(path, "/"), lambda w: w != "")

    def place(i: Column, placed: int) -> Column:
        return F.when(i < placed, i.cast("string")).otherwise("")

    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(scheme))),
        F.transform(labels, lambda w, i: F.concat(F.lit("host"), place(i, LABELS), F.lit(":"), w)),
        F.transform(words, lambda w, i: F.concat(F.lit("path"), place(i, SEGMENTS), F.lit(":"),
                                                 F.regexp_replace(F.lower(w), "[0-9]+", "0"))),
        F.transform(keys, lambda w: F.concat(F.lit("query:"), F.lower(w))))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(parts, F.array().cast("array<string>")),
                                                  lambda t: ~t.rlike(":$"))))


def mine(examples: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) learned from ``examples`` (tokens, verdict).

    FP-growth finds token combinations with a verdict that hold in at least ``min_support`` of the examples.
    A combination becomes a rule if ``min_confidence`` of its examples share the verdict, and no
    smaller part of it with the same verdict is at least as sure.

    Tokens that the same examples have, as the words of a deep path, would double the combinations each; only the
    smallest of them is mined, and the others take its place in the rules found. No rule is lost by
    that: one with two such tokens is no surer than without either.
    """
    sign = [F.sum(F.xxhash64(F.lit(i), "tokens").cast("decimal(38,0)")).alias(f"sign{i}") for i in (0, 1)]
    frequent = (examples.select("tokens", F.explode("tokens").alias("token")).groupBy("token")
                .agg(F.count(F.lit(1)).alias("n"), *sign)
                .join(F.broadcast(examples.agg((F.count(F.lit(1)) * min_support).alias("least"))), F.col("n") >= F.floor("least")))
    alike = stored(frequent.groupBy("n", "sign0", "sign1").agg(F.array_sort(F.collect_list("token")).alias("alike"))
                   .filter("size(alike) > 1").select(F.col("alike")[0].alias("token"), "alike"), "url-alike")
    # One row.
    others = alike.agg(F.flatten(F.collect_list(F.slice("alike", 2, F.size("alike")))).alias("others"))
    baskets = examples.crossJoin(F.broadcast(others)).select(F.concat(F.array_except("tokens", "others"), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter("consequent[0] IN ('verdict:allow', 'verdict:block')").select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 9).alias("verdict"),
        "confidence", "support").filter("NOT exists(tokens, t -> t LIKE 'verdict:%')")
    rules = stored(found, "url-rules")
    part = rules.select("verdict", F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    smaller = (rules.filter("size(tokens) > 1")
               .select("tokens", "verdict", "confidence",
                       F.explode(F.transform(F.col("tokens"), lambda t: F.array_remove(F.col("tokens"), t))).alias("part"))
               .join(part, ["verdict", "part"]).filter("sure >= confidence").select("tokens", "verdict"))
    lean = rules.join(smaller, ["tokens", "verdict"], "left_anti")
    chosen = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda sets, ways: F.flatten(
        F.transform(sets, lambda s: F.transform(ways, lambda t: F.concat(s, F.array(t))))))
    return (lean.select("*", F.explode("tokens").alias("token")).join(F.broadcast(alike), "token", "left")
            .groupBy("tokens", "verdict", "confidence", "support")
            .agg(F.collect_list(F.coalesce("alike", F.array("token"))).alias("choices"))
            .select(F.explode(chosen).alias("tokens"), "verdict", "confidence", "support")
            .withColumn("tokens", F.array_sort("tokens")))


def match(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest rule of every distinct token set in ``addresses`` (tokens): tokens, learned.

    An inverted index posts each rule under its rarest token only; a token set looks up its tokens and
    checks the other tokens of the rules it finds. Ties: more support, then fewer and smaller tokens, allow.
    """
    named = rules.withColumnRenamed("tokens", "needed")
    posts = named.select(F.explode("needed").alias("token"), "needed", "verdict", "confidence", "support")
    spread = posts.groupBy("token").agg(F.count(F.lit(1)).alias("rules"))
    rarest = (posts.join(spread, "token").groupBy("needed", "verdict", "confidence", "support")
              .agg(F.min(F.struct("rules", "token")).alias("r"))
              .select(F.col("r.token").alias("token"), "needed", "verdict", "confidence", "support"))
    sets = addresses.select("tokens").distinct()
    hits = (sets.select("tokens", F.explode("tokens").alias("token")).join(rarest, "token")
            .filter(F.size(F.array_except("needed", "tokens")) == 0))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"),
                          F.size("needed").alias("n"), "needed", "verdict"))
    return hits.groupBy("tokens").agg(best.alias("b")).select(
        "tokens", F.col("b.verdict").alias("learned"), F.col("b.needed").alias("why"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``why`` (tokens of the mined rule).

    The longest listed rule decides. Pages with a listed rule are the labels that the mined rules learn from; those
    decide the others. Where no mined rule matches, the commoner label decides, allow in a tie or
    without labels. A null address, or one without ``://``, has an empty host and path. Repeated rows
    are judged alike, one result row each; extra columns are ignored; an empty table gives no rows.
    """
    url = F.col("url")
    base = stored(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
                  .withColumn("host", host_of(url)).withColumn("path", path_of(url))
                  .withColumn("tokens", tokens(url, F.col("host"), F.col("path")))
                  .withColumn("fit", listed(F.col("host"), F.col("path"), rules)).drop("url"), "urls")
    examples = base.filter("fit IS NOT NULL").select("tokens", F.col("fit.verdict").alias("verdict"))
    blocked = examples.agg(F.avg((F.col("verdict") == BLOCK).cast("double"))).first()[0]
    common = BLOCK if blocked is not None and blocked > 0.5 else ALLOW
    if blocked is None:
        learned = base.select("tokens", F.lit(None).cast("string").alias("learned"),
                              F.lit(None).cast("array<string>").alias("why")).limit(0)
    else:
        # Stored, so that the join below can split a token set that very many pages have.
        learned = stored(match(base.filter("fit IS NULL"), mine(examples, min_support, min_confidence)), "url-learned")
    judged = base.filter("fit IS NULL").join(learned, "tokens", "left").select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("learned", F.lit(common)).alias("verdict"), "why")
    ruled = base.filter("fit IS NOT NULL").select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"),
        F.lit(None).cast("array<string>").alias("why"))
    return ruled.unionByName(judged).withColumnRenamed("id", id_col)
