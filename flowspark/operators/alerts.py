"""Alert enrichment, de-duplication and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowspark.functions import alerts as A
from flowspark.functions import scores as S
from flowspark.functions.keys import ip_prefix, ipv4_to_long, ipv6_groups
from flowspark.functions.times import micros
from flowspark.operators.ordered import CHUNK, ROW, Ordered, chunk_of, earlier, in_runs, run_width, runs, with_carry
from flowspark.schemas import IP_INFO, SEVERITIES

MICRO = 1_000_000
#: Width of a key's chunks in ordered passes: alerts are rare enough for an hour of one key to be a task's work.
WIDTH_US = 3600 * MICRO
#: Groups of up to this many alerts are scored whole by one task; those of larger ones in chunks.
PART = 25_000


def with_micros(df: DataFrame) -> DataFrame:
    """``ts_us`` from ``timestamp`` where the record does not carry it."""
    return df if "ts_us" in df.columns else df.withColumn("ts_us", micros("timestamp"))


def prepare_alerts(detections: DataFrame) -> DataFrame:
    """Severity, status, keys and destination of every detection."""
    df = with_micros(detections).withColumn("severity", S.severity_from_type("alert_type"))
    return df.withColumns(
        {
            "status": F.lit("new"),
            "alert_id": A.alert_id(),
            "dedup_key": A.dedup_key(),
            "group_id": A.single_correlation_id(),
            "output_topic": S.route("severity"),
        }
    )


# --- J2 -----------------------------------------------------------------------
DOMAIN_INFO = "domain string, registrar string, creation_date string, expiration_date string"


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(",")]


def _networks(cidr_dim: DataFrame) -> DataFrame:
    """The dimension keyed by (prefix length, prefix bits), one row per network; rows that name no network are left out."""
    parts = F.split("network", "/")
    address = F.get(parts, F.lit(0))
    keyed = cidr_dim.select("*", F.get(parts, F.lit(1)).try_cast("int").alias("_plen"), address.alias("_address"))
    known = [f.split()[0] for f in IP_INFO.split(",")]
    info = F.struct(
        *[F.col(f) if f in cidr_dim.columns else F.lit(None).cast("string").alias(f) for f in known]
    )
    return (
        keyed.withColumn("_net", ip_prefix("_address", F.col("_plen")))
        .filter(F.col("_net").isNotNull())
        .groupBy("_plen", "_net")
        .agg(F.min(info).alias("_info"))
    )


def ip_lookup(ips: DataFrame, cidr_dim: DataFrame) -> DataFrame:
    """``ip, info`` of the longest matching prefix, as an equi-join on (length, prefix bits).

    An IPv4 address becomes 33 candidates, an IPv6 address 129, whatever the dimension holds.
    """
    longest = F.when(ipv4_to_long("ip").isNotNull(), 32).when(ipv6_groups("ip").isNotNull(), 128)
    wanted = ips.withColumn("_plen", F.explode(F.sequence(F.lit(0), longest)))
    wanted = wanted.withColumn("_net", ip_prefix("ip", F.col("_plen")))
    # sizes decide the join at run time (broadcast if small, split if one network is hot)
    hits = wanted.join(_networks(cidr_dim), ["_plen", "_net"])
    return hits.groupBy("ip").agg(F.max_by("_info", "_plen").alias("info"))


def enrich_ips(alerts: DataFrame, cidr_dim: DataFrame, domain_dim: DataFrame | None = None, seen_in: DataFrame | None = None) -> DataFrame:
    """Add ``src_ip_enrichment`` and ``dst_ip_enrichment`` (null when nothing matches).

    Addresses are looked up once each. ``domain_dim`` (``ip`` plus attributes) overrides
    the fields of the network result that it gives, and adds the domain's own. ``seen_in`` is a cheaper frame holding all
    of the addresses, where ``alerts`` is costly to compute.
    """
    ends = F.explode(F.array("src_ip", "dst_ip")).alias("ip")
    ips = (seen_in if seen_in is not None else alerts).select(ends).filter("ip is not null").distinct()
    info = ip_lookup(ips, cidr_dim)
    if domain_dim is not None:
        names = _names(IP_INFO) + _names(DOMAIN_INFO)
        given = [f for f in names if f in domain_dim.columns]
        wide = domain_dim.filter("ip is not null").groupBy("ip").agg(F.min(F.struct(*given)).alias("_domain"))
        told = {f: F.col(f"_domain.{f}") if f in given else F.lit(None) for f in names}
        # a field of the domain table overrides the network's where it says something
        info = info.join(wide, "ip", "full_outer").select(
            "ip",
            F.struct(
                *[F.coalesce(told[f], F.col(f"info.{f}")).alias(f) for f in _names(IP_INFO)],
                *[told[f].cast("string").alias(f) for f in _names(DOMAIN_INFO)],
            ).alias("info"),
        )
    out = alerts
    for side in ("src_ip", "dst_ip"):
        found = info.select(F.col("ip").alias(side), F.col("info").alias(f"{side}_enrichment"))
        out = out.join(found, side, "left")
    return out


# --- W4, A21, J6 ----------------------------------------------------------------
def dedup_runs(alerts: DataFrame, window_s: int = 300, tie: str = "alert_id") -> DataFrame:
    """Add ``is_first`` and ``run_us``: a run goes on while each alert is within the window of the last.

    Alerts of equal key, time and tie value can't be told apart: as first ones all of them are marked.
    """
    place = F.struct("ts_us", tie)
    rows = in_runs(alerts, ["dedup_key"], "ts_us", window_s * MICRO, keep=["is_new", "_first"], _first=F.min(place))
    return rows.withColumn("is_first", F.col("is_new") & (place == F.col("_first"))).withColumnRenamed("run_at", "run_us").drop("is_new", "_first")


def dedup_alerts(alerts: DataFrame, window_s: int = 300, keep: str = "first", tie: str = "alert_id") -> DataFrame:
    """The first alert of every run, alone or with the merged run beside it (``keep="merged"``)."""
    if keep == "first":
        # a run starts with a chunk's first alert: that one, not each alert, is what the chunks' summaries carry
        rest = [c for c in alerts.columns if c != "dedup_key"]
        spans = runs(alerts, ["dedup_key"], "ts_us", window_s * MICRO, _row=F.min_by(F.struct(*rest), F.struct("ts_us", tie)))
        return spans.filter("is_new").select(*[c if c == "dedup_key" else F.col("_row")[c].alias(c) for c in alerts.columns])
    runs_ = dedup_runs(alerts, window_s, tie)
    return merge_duplicates(runs_, ["dedup_key", "run_us"], tie)


def merge_duplicates(alerts: DataFrame, by: Sequence[str], tie: str = "alert_id") -> DataFrame:
    """One row per duplicate set: count, first and last seen, highest severity, merged correlation."""
    place = F.struct("ts_us", tie)
    rank = F.max(S.severity_rank("severity"))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    kept = [c for c in ("alert_type", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol") if c in alerts.columns]
    merged = alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dedup_count"),
        F.min("ts_us").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.get(names, rank).alias("severity"),
        F.min_by(F.struct(tie, *kept), place).alias("_first"),
        *([F.max("correlation_score").alias("correlation_score")] if "correlation_score" in alerts.columns else []),
    )
    merged = merged.select("*", "_first.*").drop("_first")
    if "correlated_alerts" not in alerts.columns:
        return merged
    # distinct ids before they are gathered, in first-seen order
    ids = alerts.select(*by, place.alias("_place"), F.posexplode("correlated_alerts").alias("_i", "_id"))
    seen = ids.groupBy(*by, "_id").agg(F.min(F.struct("_place", "_i")).alias("_at"))
    lists = seen.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("correlated_alerts")
    )
    return merged.join(lists, list(by), "left").withColumn(
        "correlated_alerts", F.coalesce("correlated_alerts", F.array().cast("array<string>"))
    )


def suppress_seen(alerts: DataFrame, seen: DataFrame, window_s: int = 300) -> DataFrame:
    """Alerts whose key was not seen within the window before them (``seen``: dedup_key, last_seen_us)."""
    last = seen.groupBy("dedup_key").agg(F.max("last_seen_us").alias("_last"))
    age = F.col("ts_us") - F.col("_last")
    return alerts.join(last, "dedup_key", "left").filter(F.col("_last").isNull() | (age > window_s * MICRO)).drop("_last")


# --- A12, W5, A13, J3 -------------------------------------------------------------
def correlation_id(alerts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``group_id`` of each alert set: hash of its sorted distinct flows and address pairs.

    Distinct values are found before anything is gathered, so a group's size is the number
    of its distinct flows, not of its alerts.
    """
    flow = F.when(F.octet_length("flow_key") > 0, F.col("flow_key"))
    paired = (F.octet_length("src_ip") > 0) & (F.octet_length("dst_ip") > 0)
    pair = F.when(paired, F.struct("src_ip", "dst_ip"))
    distinct = alerts.select(*by, flow.alias("_flow"), pair.alias("_pair")).distinct()
    sets = distinct.groupBy(*by).agg(
        F.array_sort(F.collect_set("_flow")).alias("_flows"), F.array_sort(F.collect_set("_pair")).alias("_pairs")
    )
    pairs = F.transform("_pairs", lambda p: F.concat(p["src_ip"], F.lit("->"), p["dst_ip"]))
    text = F.concat(F.lit("flows="), F.array_join("_flows", ","), F.lit("|ips="), F.array_join(pairs, ","))
    return sets.select(*by, F.substring(F.sha2(text, 256), 1, 16).alias("group_id"))


def correlation_sessions(alerts: DataFrame, idle_s: int = 3600, tie: str = "alert_id") -> DataFrame:
    """Add ``group_id`` and ``session_us``; a session closes after more than ``idle_s`` idle."""
    df = with_micros(alerts).withColumn("group_id", A.single_correlation_id())
    return in_runs(df, ["group_id"], "ts_us", idle_s * MICRO).withColumnRenamed("run_at", "session_us")


def _ranked(df: DataFrame, idle_us: int, tie: str) -> DataFrame:
    """Alerts with their session and their 0-based rank ``_k`` in it."""
    width = run_width(idle_us, WIDTH_US)
    spans = runs(df, ["group_id"], "ts_us", idle_us, width)
    so_far = F.sum("n").over(earlier(["group_id", "run_at"]))
    carry = spans.select("group_id", CHUNK, F.struct("run_at", F.coalesce(so_far, F.lit(0)).alias("n")).alias("_span"))
    order = Window.partitionBy("group_id", CHUNK).orderBy(ROW, "ts_us", tie)
    rows = with_carry(df.withColumn(CHUNK, chunk_of("ts_us", width)), carry).withColumns(
        {"_span": F.first("_span").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(order)}
    )
    rows = rows.filter(F.col(ROW) == 1).withColumns({"session_us": F.col("_span.run_at"), "_k": F.col("_k") - 2 + F.col("_span.n")})
    return rows.drop(CHUNK, ROW, "_span")


def _ranked_whole(df: DataFrame, idle_us: int, tie: str) -> DataFrame:
    """As ``_ranked``, for groups that fit a task."""
    order = Window.partitionBy("group_id").orderBy("ts_us", tie)
    ts, before = F.col("ts_us"), F.lag("ts_us").over(order)
    df = df.withColumn("_new", before.isNull() | (ts - before > idle_us))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("session_us", F.max(F.when(F.col("_new"), ts)).over(upto))
    place = F.row_number().over(Window.partitionBy("group_id", "session_us").orderBy("ts_us", tie))
    return df.withColumn("_k", (place - 1).cast("long")).drop("_new")


#: What has to match in a class of members.
CLASSES = {"a": [], "p": ["dst_port"], "q": ["protocol"], "b": ["dst_port", "protocol"]}
GROUP = ["group_id", "session_us"]
HOUR_US = 3600 * MICRO


def _arrivals(ranked: DataFrame) -> tuple[DataFrame, list[str]]:
    """Every member, and the same once more when it turns one hour old (kind 0, before a real arrival of that instant), and
    the columns to be summed: prefix sums over those rows count the far members."""
    rows = ranked.withColumn("_t", (F.col("ts_us") - F.col("session_us")).cast("double"))
    both = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn(
        "_at", F.col("ts_us") + F.when(F.col("_copy") == 0, F.lit(HOUR_US)).otherwise(F.lit(0))
    )
    k, t = F.col("_k").cast("double"), F.col("_t")
    terms = {"c": F.lit(1.0), "i": k, "t": t, "it": k * t}
    real = F.col("_copy") == 1
    # a member counts as near until its second arrival takes it away again; far ones have no time part
    values = {f"_x_near_{s}": F.when(real, v).otherwise(-v) for s, v in terms.items()}
    values |= {f"_x_far_{s}": F.when(~real, terms[s]).otherwise(0.0) for s in ("c", "i")}
    return both.withColumns(values), list(values)


def _summed_whole(both: DataFrame, values: list[str], tie: str) -> DataFrame:
    """The class sums up to each arrival, for groups that fit a task."""
    for name, extra in CLASSES.items():
        upto = Window.partitionBy(*GROUP, *extra).orderBy("_at", "_copy", tie).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({n.replace("_x", f"_{name}", 1): F.sum(n).over(upto) for n in values})
    return both.drop(*values)


def _summed_chunks(both: DataFrame, values: list[str], tie: str) -> DataFrame:
    """The class sums up to each arrival: inside chunks of an hour, each class has carry rows for what came before."""
    both = both.withColumn(CHUNK, chunk_of("_at", WIDTH_US))
    summary = both.groupBy(*GROUP, CHUNK, *CLASSES["b"]).agg(*[F.sum(n).alias(n) for n in values])
    # once per class, without what need not match in it
    each = summary.withColumn("_class", F.explode(F.array(*[F.lit(name) for name in CLASSES])))
    each = each.withColumns({c: F.when(F.col("_class").isin([name for name, extra in CLASSES.items() if c in extra]), F.col(c)) for c in CLASSES["b"]})
    own = ["_class", *CLASSES["b"]]
    each = each.groupBy(*GROUP, CHUNK, *own).agg(*[F.sum(n).alias(n) for n in values])
    past = earlier([*GROUP, *own])
    carries = each.select(*GROUP, CHUNK, *own, *[F.sum(n).over(past).alias(n) for n in values]).filter("_x_far_c is not null")
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = with_carry(both, carries).repartition(parts, *GROUP, CHUNK)
    for name, extra in CLASSES.items():
        upto = Window.partitionBy(*GROUP, CHUNK, *extra).orderBy(ROW, "_at", "_copy", tie).rowsBetween(Window.unboundedPreceding, 0)
        counts = (F.col(ROW) == 1) | (F.col("_class") == name)
        both = both.withColumns({n.replace("_x", f"_{name}", 1): F.sum(F.when(counts, F.col(n))).over(upto) for n in values})
    return both.filter(F.col(ROW) == 1).drop(CHUNK, ROW, "_class", *values)


def group_scores(alerts: DataFrame, idle_s: int = 3600, tie: str = "alert_id") -> DataFrame:
    """Correlation score of the group at each arrival, in one linear pass per match class.

    The score of arrival k is the mean of score(a_i, a_k) over its earlier members, weighted
    k - i. Inside a group only port, protocol and time proximity vary, so that sum splits into
    classes (port match x protocol match x closer than an hour), and in each class it needs
    just the prefix sums of 1, i, t and i*t. No pair is ever formed, whatever the group size.
    Rows are shuffled once, by their group; groups of more than PART alerts, in which no task
    holds more than an hour, pass through summaries and carry rows besides.
    """
    df = with_micros(alerts).withColumn("group_id", A.single_correlation_id())
    cols, idle_us = [*df.columns, *([] if "session_us" in df.columns else ["session_us"])], idle_s * MICRO
    # at most one row per PART alerts
    large = F.broadcast(df.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART).select("group_id"))
    # the number of tasks is named: they hold the copies and sums too, far more than is shuffled for them
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole, values = _arrivals(_ranked_whole(df.join(large, "group_id", "left_anti").repartition(parts, "group_id"), idle_us, tie))
    hot, _ = _arrivals(_ranked(df.join(large, "group_id", "left_semi"), idle_us, tie))
    both = _summed_whole(whole, values, tie).unionByName(_summed_chunks(hot, values, tie))
    scored = both.filter(F.col("_copy") == 1)

    def zero_unless(name: str, c: Column) -> Column:
        """A null or zero port (protocol) never matches."""
        ok = F.lit(True)
        for g in CLASSES[name]:
            ok = ok & F.coalesce(F.col(g) != 0, F.lit(False))
        return F.when(ok, c).otherwise(0.0)

    k, t = F.col("_k").cast("double"), F.col("_t")

    def sums_of(kind: str) -> dict[str, dict[str, Column]]:
        got: dict[str, dict[str, Column]] = {}
        used = ["c", "i", "t", "it"] if kind == "near" else ["c", "i"]
        for name in CLASSES:
            for s in used:
                got.setdefault(name, {})[s] = zero_unless(name, F.col(f"_{name}_{kind}_{s}"))
        exact: dict[tuple[int, int], dict[str, Column]] = {}
        for s in used:
            a, p, q, b = (got[n][s] for n in "apqb")
            exact.setdefault((1, 1), {})[s] = b
            exact.setdefault((1, 0), {})[s] = p - b
            exact.setdefault((0, 1), {})[s] = q - b
            exact.setdefault((0, 0), {})[s] = a - p - q + b
        return exact

    flow = F.octet_length("flow_key") > 0
    src, dst = F.octet_length("src_ip") > 0, F.octet_length("dst_ip") > 0
    flow, src, dst = (F.coalesce(c, F.lit(False)) for c in (flow, src, dst))
    # the group key holds the address pair only when both ends are present
    points = F.when(flow, A.POINTS["flow"]).otherwise(0.0) + F.when(src & dst, A.POINTS["pair"]).otherwise(0.0)
    factors = flow.cast("int") + (src & dst).cast("int")
    total: Column = F.lit(0.0)
    for kind in ("near", "far"):
        for (p, q), s in sums_of(kind).items():
            weight = k * s["c"] - s["i"]
            fixed = points + A.POINTS["port"] * p + A.POINTS["protocol"] * q
            n = factors + p + q + (1 if kind == "near" else 0)
            value = fixed * weight
            if kind == "near":
                lag = k * t * s["c"] - k * s["t"] - t * s["i"] + s["it"]
                value = value + A.POINTS["time"] * (weight - lag / float(HOUR_US))
            total = total + value / F.greatest(n, F.lit(1))
    pairs = k * (k + 1) / 2
    return scored.withColumn(
        "correlation_score", F.when(F.col("_k") > 0, total / pairs).otherwise(0.0)
    ).select(*[c for c in cols if not c.startswith("_")], F.col("_k").alias("group_rank"), "correlation_score")


LINK_KEYS = {"flow": ["flow_key"], "pair": ["src_ip", "dst_ip"], "src": ["src_ip"], "dst": ["dst_ip"]}


def _related(alerts: DataFrame, keys: list[str], window_s: int, min_score: float, tie: str) -> DataFrame:
    """Pairs ``a, b, score`` of alerts with the same keys, b earlier in the window, that reach the score."""
    span = max(window_s, 1) * MICRO
    present = F.lit(True)
    for key in keys:
        present = present & (F.octet_length(key) > 0)
    me = F.struct(*[F.col(f) for f in A.CORRELATION_FIELDS], F.col(tie).alias("id"))
    rows = with_micros(alerts).filter(present).select(*[F.col(k).alias(f"_{k}") for k in keys], F.floor(F.col("ts_us") / span).alias("_slot"), me.alias("a"))
    names = [f"_{k}" for k in keys] + ["_slot"]
    earlier = rows.withColumn("_slot", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1))).withColumnRenamed("a", "b")
    at = lambda x: F.struct(F.col(f"{x}.ts_us"), F.col(f"{x}.id"))
    pairs = rows.join(earlier, names).filter((at("b") < at("a")) & (F.col("a.ts_us") - F.col("b.ts_us") <= window_s * MICRO))
    return pairs.select("a", "b", A.correlation_score(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= min_score)


def _scored_links(alerts: DataFrame, window_s: int, min_score: float, tie: str) -> DataFrame:
    links = None
    for keys in LINK_KEYS.values():
        near = F.max(F.struct("b.ts_us", "b.id", "score"))
        one = _related(alerts, keys, window_s, min_score, tie).groupBy(F.col("a.id").alias("alert"), F.col("a.ts_us").alias("ts_us")).agg(near.alias("n"))
        links = one if links is None else links.unionByName(one)
    return links.distinct().select(
        "alert", F.col("n.id").alias("linked_to"), ((F.col("ts_us") - F.col("n.ts_us")) / F.lit(1e6)).alias("gap_s"), "n.score"
    )


def correlation_counts(alerts: DataFrame, window_s: int = 3600, min_score: float = 0.0, tie: str = "alert_id") -> DataFrame:
    """``alert, n_related, best_score`` of each alert with earlier alerts of the same flow, source or target in the window.

    Only those that score ``min_score`` count, each once. All pairs of a window are scored.
    """
    pairs = None
    for keys in (["flow_key"], ["src_ip"], ["dst_ip"]):
        one = _related(alerts, keys, window_s, min_score, tie)
        # a pair that an earlier key finds as well is left to that key
        for seen in {"flow_key": [], "src_ip": ["flow_key"], "dst_ip": ["flow_key", "src_ip"]}[keys[0]]:
            same = (F.octet_length(f"a.{seen}") > 0) & (F.col(f"a.{seen}") == F.col(f"b.{seen}"))
            one = one.filter(~F.coalesce(same, F.lit(False)))
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs.groupBy(F.col("a.id").alias("alert")).agg(F.count(F.lit(1)).alias("n_related"), F.max("score").alias("best_score"))


def correlation_links(alerts: DataFrame, window_s: int = 3600, min_score: float = 0.0, tie: str = "alert_id") -> DataFrame:
    """Each alert linked to its nearest earlier alert of the same flow, pair, source and target that scores ``min_score``.

    Up to four links per alert, so the output stays linear in the input (all pairs of a hot
    source would not). With ``min_score`` 0 the links chain every related alert of the window
    together and are found in linear time; a higher one has to score all pairs of a window.
    """
    if min_score > 0:
        return _scored_links(alerts, window_s, min_score, tie)
    df = bare = with_micros(alerts)
    # columns a record lacks stay null and never match
    me = F.struct(*[F.col(f) for f in A.CORRELATION_FIELDS], F.col(tie).alias("id"))
    links = []
    for name, keys in LINK_KEYS.items():
        # summaries are made of the bare alerts: ``df`` carries the links found so far
        df = Ordered(df, keys, ["ts_us", tie], WIDTH_US).prev(**{f"_{name}": me}).result(source=bare)
        present = F.lit(True)
        for key in keys:
            present = present & (F.octet_length(key) > 0)
        near = F.col("ts_us") - F.col(f"_{name}.ts_us") <= window_s * MICRO
        links.append(F.when(present & near, F.col(f"_{name}")))
    linked = df.select(me.alias("a"), F.explode(F.array_distinct(F.array_compact(F.array(*links)))).alias("b"))
    return (
        linked.withColumn("score", A.correlation_score(F.col("a"), F.col("b")))
        .filter(F.col("score") >= min_score)
        .select(
            F.col("a.id").alias("alert"),
            F.col("b.id").alias("linked_to"),
            ((F.col("a.ts_us") - F.col("b.ts_us")) / F.lit(1e6)).alias("gap_s"),
            "score",
        )
    )
