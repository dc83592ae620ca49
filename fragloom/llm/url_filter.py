"""A listing of canonical urls, and url rules, behind a blocked Bloom filter, with DataFrame functions only.

Listed urls and pages' urls are brought to one canonical form, which is a page's one key for the listing.  A rule is a host and a
path prefix; a page's url has few keys that a rule could equal: each suffix of its host with each prefix of its path that is as long as
some rule's path.  All keys probe a blocked Bloom filter of listed urls and rules (one 256-bit block for a key, eight bits of it), and only
possible hits go on to the exact hash join, which removes false positives.  The filter and the exact table are each broadcast while their own bytes,
computed first, are under the bound, and joined by shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, BITS = 4, 2  # 64-bit words of a block, bits of a key in each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows of a short list, as one literal."""
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    if not each:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*each)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no ``://``."""
    has = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), "^[^?#]*", 0)
    return F.when(has, F.translate(raw, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


#: Fixed values of the canonical form: hexadecimal codes of characters that need no encoding; parameters that only track; default ports.
UNRESERVED = "^(?:2[DEde]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])"
TRACKING = "^(?:utm_[A-Za-z]+|gclid|fbclid|msclkid)(?:=|$)"
DEFAULT_PORTS = {"http": "80", "https": "443"}


def _decoded(c: Column) -> Column:
    """Percent codes of characters that need none decoded, the others' digits in upper case."""
    one = lambda x, i: (
        F.when(i == 0, x)
        .when(x.rlike(UNRESERVED), F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long")), F.substring(x, F.lit(3), F.length(x))))
        .when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), F.substring(x, F.lit(3), F.length(x))))
        .otherwise(F.concat(F.lit("%"), x))
    )
    return F.when(F.contains(c, F.lit("%")), F.array_join(F.transform(F.split(c, "%"), one), "")).otherwise(c)


def _without_dots(path: Column) -> Column:
    """``/./`` and ``/x/../`` worked off."""
    whole = F.concat(path, F.when(path.rlike("/\\.{1,2}$"), F.lit("/")).otherwise(""))
    steps = F.split(F.substring(whole, F.lit(2), F.length(whole)), "/")
    fold = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), fold)
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def with_canonical(rows: DataFrame, url_col: str = "url", name: str = "canonical") -> DataFrame:
    """``rows`` with the canonical form of a url, without its scheme: host in lower case, no user, default port, final dot or fragment, ``/`` for no path, needless percent
    codes decoded, dot segments worked off, tracking parameters left out.  Null for null and where there is no ``://`` or no host.

    Each step is a column of its own, so nothing is worked out twice.  Columns that begin with ``_c_`` are taken for it.
    """
    url, c = F.col(url_col), lambda x: F.col(f"_c_{x}")
    parameters = F.filter(F.split(F.regexp_extract(c("behind"), r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    steps = [
        {"at": F.locate("://", url)},
        {"rest": F.when(c("at") > 0, F.substring(url, c("at") + 3, F.length(url))), "scheme": F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))},
        {"raw": F.regexp_extract(c("rest"), "^[^/?#]*", 0)},
        {"server": F.translate(F.regexp_replace(c("raw"), "^.*@", ""), UPPER, LOWER), "behind": F.substring(c("rest"), F.length(c("raw")) + 1, F.length(c("rest")))},
        {
            "host": F.regexp_replace(F.regexp_extract(c("server"), r"^(\[[^\]]*\]|[^:]*)", 1), r"\.+$", ""), "port": F.regexp_replace(F.regexp_extract(c("server"), ":([0-9]*)$", 1), "^0+", ""),
            "path": F.regexp_extract(c("behind"), "^[^?#]*", 0), "query": F.array_join(parameters, "&"),
        },
        {"path": _decoded(F.when(c("path") == "", F.lit("/")).otherwise(c("path"))), "query": _decoded(c("query"))},
        {"path": _without_dots(c("path"))},
    ]
    out = rows
    for step in steps:
        out = out.withColumns({f"_c_{k}": v for k, v in step.items()})
    default = F.when(c("scheme") == "http", DEFAULT_PORTS["http"]).when(c("scheme") == "https", DEFAULT_PORTS["https"]).otherwise("")
    key = F.concat(c("host"), F.when(c("port").isin("") | (c("port") == default), "").otherwise(F.concat(F.lit(":"), c("port"))), c("path"), F.when(c("query") == "", "").otherwise(F.concat(F.lit("?"), c("query"))))
    return out.withColumn(name, F.when((c("at") > 0) & (c("host") != ""), key)).drop(*[f"_c_{k}" for step in steps for k in step])


def listing(pages: DataFrame, sites: Iterable[str], url_col: str = "url") -> DataFrame:
    """(url, verdict): the canonical urls of all pages on hosts with one of ``sites`` among their labels; a listing made from an earlier crawl."""
    urls = with_canonical(pages.select(F.col(url_col).alias("url"))).select(F.col("canonical").alias("url")).filter(F.col("url").isNotNull()).distinct()
    own = F.split(F.regexp_extract(F.col("url"), "^[^/:?]*", 0), r"\.")
    return urls.filter(F.arrays_overlap(own, F.array(*[F.lit(x) for x in sites]))).select(F.concat(F.lit("http://"), "url").alias("url"), F.lit("block").alias("verdict"))


def _block_and_masks(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    h = F.xxhash64(key, F.lit("bits"))

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    return block, [bit(BITS * w).bitwiseOR(bit(BITS * w + 1)) for w in range(WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w3): the filter's blocks that hold any of ``keys``' column ``key``."""
    block, masks = _block_and_masks(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_key: int = 24,
    broadcast_mb: int = 64,
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict and listed.

    ``rules`` has host, path and verdict.  A rule fits its host and all subdomains of it where the url's path
    starts with the rule's path; the longest key (host and path) wins, on a tie the longer host, then the lesser verdict.  ``rule`` is the key
    of the rule, like ``net/``, or null.  ``listed`` has url and verdict; where no rule fits, the entry whose canonical form is the page's decides (that form is in
    ``listed``; of several verdicts the lesser), else ``default``.  Null urls and urls without ``://`` have an empty host and path and no key, so they
    get ``default``.  Rows with equal or null ids are judged each for themselves, ids may be of any type; other columns are not read.  Repeated rules and entries count once,
    rules with a null or an empty host or a null path, and entries without a canonical form, never fit.  Empty tables give no rows, or no hits.
    """
    base = rules.filter((F.col("host") != "") & F.col("path").isNotNull())
    base = base.select(F.concat(F.lit("r"), F.translate("host", UPPER, LOWER), "path").alias("key"), F.length("host").alias("n_host"), F.length("path").alias("n_path"), F.col("verdict").alias("found"))
    if listed is not None:
        more = with_canonical(listed.select("url", "verdict")).select(F.concat(F.lit("u"), "canonical").alias("key"), F.lit(-1).alias("n_host"), F.lit(-1).alias("n_path"), F.col("verdict").alias("found"))
        base = base.unionByName(more.filter(F.col("key").isNotNull()))
    exact = base.groupBy("key").agg(F.max("n_host").alias("n_host"), F.min("found").alias("found"))
    # One small row: how many keys there are, their bytes, and the few lengths of rules' paths.
    facts = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length(F.coalesce("found", F.lit("")))), F.lit(0)).alias("bytes"), F.collect_set(F.when(F.col("n_path") >= 0, F.col("n_path"))).alias("lengths")).first()
    n, lengths = facts["n"], sorted(facts["lengths"])
    blocks = 1 << max(0, (n * bits_per_key // (64 * WORDS)).bit_length())
    room = broadcast_mb << 20
    bloom = bloom_blocks(exact, blocks)
    bloom = F.broadcast(bloom) if blocks * (WORDS + 1) * 8 <= room else bloom
    exact = F.broadcast(exact) if facts["bytes"] + 64 * n <= room else exact

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), path.alias("path"))
    rows = with_canonical(rows) if listed is not None else rows.withColumn("canonical", F.lit(None).cast("string"))
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("path")) if lengths else F.array().cast("array<int>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda x: F.concat(s, F.substring(F.col("path"), F.lit(1), x)))))
    keys = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda x: F.concat(F.lit("r"), x))
    keys = F.when(F.col("canonical").isNull(), keys).otherwise(F.concat(keys, F.array(F.concat(F.lit("u"), "canonical"))))
    each = rows.select("row", "page_id", "host", "path", F.posexplode_outer(keys).alias("slot", "key"))
    block, masks = _block_and_masks(F.col("key"), blocks)
    probes = each.withColumn("probe_block", block)
    for i, m in enumerate(masks):
        probes = probes.withColumn(f"m{i}", m)
    passes = F.col("probe_block") == F.col("block")
    for i in range(WORDS):
        passes &= F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}")
    # A page's first key stays in any case, so that no page is lost; of the others only possible hits do.
    possible = probes.join(bloom, passes, "left").filter(F.col("block").isNotNull() | F.coalesce(F.col("slot") == 0, F.lit(True)))
    possible = possible.select("row", "page_id", "host", "path", F.when(F.col("block").isNotNull(), F.col("key")).alias("key"))
    found = possible.join(exact, "key", "left")
    hit = F.struct(F.length("key"), F.col("n_host"), F.substring(F.col("key"), F.lit(2), F.length("key")).alias("key"), F.col("found").alias("verdict"))
    out = found.groupBy("row").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(F.when(F.col("n_host") >= 0, hit)).alias("b"),
        F.max(F.when(F.col("n_host") < 0, hit)).alias("l"),
    )
    return out.select("page_id", "host", "path", F.col("b.key").alias("rule"), F.coalesce("b.verdict", "l.verdict", F.lit(default)).alias("verdict"), F.when(F.col("b").isNull(), F.col("l.key")).alias("listed"))
