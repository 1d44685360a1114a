"""Packets and flow exports to per-flow features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowspark.functions import packets as P
from flowspark.functions.keys import CANONICAL, canonical_flow, flow_id, is_forward
from flowspark.operators.ordered import CHUNK, ROW, WIDTH_US, Ordered, chunk_of, earlier, run_width, runs, with_carry
from flowspark.schemas import FEATURES, TCP_FLAGS

KEY = list(CANONICAL)
ORDER = ["ts_us", "packet_number"]
MICRO = 1e6


def _seconds(us: Column) -> Column:
    return us / F.lit(MICRO)


def _flag(name: str) -> Column:
    bit = dict(TCP_FLAGS)[name]
    return F.col("tcp_flags").bitwiseAND(F.lit(bit)) != 0


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _micros(seconds: float | None) -> int | None:
    return None if seconds is None else int(seconds * MICRO)


def _by_tag(df: DataFrame, group: list[str]) -> DataFrame:
    """What packets add up to per (group, tag): hot flows collapse before anything is shuffled."""
    # A payload cannot be both a DNS query and an HTTP request (bytes 3-4 differ): one tag.
    tag = F.coalesce(
        F.concat(F.lit("d"), F.hex(P.dns_query())), F.concat(F.lit("h"), P.http_host())
    )
    rows = df.select(
        *group,
        "ts_us",
        "packet_number",
        F.col("length").cast("long").alias("length"),
        "tcp_flags",
        P.tls_hello().alias("_tls"),
        F.when(F.octet_length("payload") > 0, F.substring("payload", 1, 256)).alias("_sample"),
        is_forward().alias("_fwd"),
        tag.alias("_tag"),
    )
    length = F.col("length")
    place = F.struct("ts_us", "packet_number")

    def total(value: Column, cond: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(0))

    flags = {f"_{n}": _count(_flag(n)) for n, _ in TCP_FLAGS[:6]}
    return rows.groupBy(*group, "_tag").agg(
        F.min("ts_us").alias("_first"),
        F.max("ts_us").alias("_last"),
        _count(F.col("_fwd")).alias("_pf"),
        _count(~F.col("_fwd")).alias("_pr"),
        total(length, F.col("_fwd")).alias("_bf"),
        total(length, ~F.col("_fwd")).alias("_br"),
        F.min("length").alias("_min"),
        F.max("length").alias("_max"),
        # squares as doubles: exact below 2^53 and never an overflow on a huge flow
        F.sum(length.cast("double") * length).alias("_sq"),
        F.count("_tls").alias("_tls"),
        F.count("_tag").alias("_tagged"),
        F.min_by("_sample", F.when(F.col("_sample").isNotNull(), place)).alias("_sample"),
        F.min(F.when(F.col("_sample").isNotNull(), place)).alias("_sample_at"),
        *[c.alias(n) for n, c in flags.items()],
    )


_SUMS = ("_pf", "_pr", "_bf", "_br", "_sq", "_tls", *[f"_{n}" for n, _ in TCP_FLAGS[:6]])


def _merged(by_tag: DataFrame, group: list[str]) -> DataFrame:
    """Sums of ``_by_tag`` in larger groups."""
    return by_tag.groupBy(*group, "_tag").agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        *[F.sum(n).alias(n) for n in (*_SUMS, "_tagged")],
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        F.min_by("_sample", "_sample_at").alias("_sample"),
        F.min("_sample_at").alias("_sample_at"),
    )


def _basic(by_tag: DataFrame, group: list[str]) -> DataFrame:
    """The 37-column features per group. Tags are rows here, so their distinct counts are plain counts."""
    kind = F.substring("_tag", 1, 1)
    flows = by_tag.groupBy(*group).agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        *[F.sum(n).alias(n) for n in _SUMS],
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        F.coalesce(F.sum(F.when(kind == "d", F.col("_tagged"))), F.lit(0)).alias("_dns"),
        _count(kind == "d").alias("_dns_u"),
        F.coalesce(F.sum(F.when(kind == "h", F.col("_tagged"))), F.lit(0)).alias("_http"),
        _count(kind == "h").alias("_http_u"),
        F.min_by("_sample", "_sample_at").alias("_sample"),
    )
    flows = flows.withColumns(
        {
            "packets_total": F.col("_pf") + F.col("_pr"),
            "bytes_total": F.col("_bf") + F.col("_br"),
            "duration": F.greatest(_seconds(F.col("_last") - F.col("_first")), F.lit(0.001)),
        }
    )
    n, s = F.col("packets_total"), F.col("bytes_total")
    mean = s / n
    variance = (F.col("_sq") - s.cast("double") * s / n) / n
    return flows.select(
        flow_id().alias("flow_id"),
        F.col("ip1").alias("src_ip"),
        F.col("ip2").alias("dst_ip"),
        F.col("port1").alias("src_port"),
        F.col("port2").alias("dst_port"),
        F.col("protocol"),
        _seconds(F.col("_first")).alias("start_time"),
        "duration",
        "packets_total",
        "bytes_total",
        F.col("_pf").alias("packets_fwd"),
        F.col("_pr").alias("packets_rev"),
        F.col("_bf").alias("bytes_fwd"),
        F.col("_br").alias("bytes_rev"),
        (n / F.col("duration")).alias("packets_per_sec"),
        (s / F.col("duration")).alias("bytes_per_sec"),
        mean.alias("avg_pkt_size"),
        F.col("_min").alias("min_pkt_size"),
        F.col("_max").alias("max_pkt_size"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("pkt_size_std"),
        (F.col("_pf") / F.greatest(F.col("_pr"), F.lit(1))).alias("fwd_rev_packet_ratio"),
        (F.col("_bf") / F.greatest(F.col("_br"), F.lit(1))).alias("fwd_rev_byte_ratio"),
        F.col("_SYN").alias("tcp_syn_count"),
        F.col("_ACK").alias("tcp_ack_count"),
        F.col("_FIN").alias("tcp_fin_count"),
        F.col("_RST").alias("tcp_rst_count"),
        F.col("_PSH").alias("tcp_psh_count"),
        F.col("_URG").alias("tcp_urg_count"),
        F.col("_dns").alias("dns_query_count"),
        F.col("_dns_u").alias("dns_unique_domains"),
        F.col("_http").alias("http_request_count"),
        F.col("_http_u").alias("http_unique_hosts"),
        F.col("_tls").alias("tls_handshake_count"),
        F.least(F.col("_tls"), F.lit(1)).alias("tls_unique_sni"),
        P.payload_entropy("_sample").alias("payload_entropy"),
        F.lit("").alias("pcap_source"),
        F.unix_seconds(F.current_timestamp()).cast("double").alias("extraction_time"),
    )


def flow_features(packets: DataFrame, timeout_s: float | None = None) -> DataFrame:
    """Features of each canonical flow over the whole input, or per session with a timeout."""
    if timeout_s is not None:
        return flow_sessions(packets, timeout_s)
    return _basic(_by_tag(canonical_flow(packets), KEY), KEY)


def flow_sessions(packets: DataFrame, timeout_s: float = 300, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As ``flow_features``, but a flow ends when it is idle for more than ``timeout_s``.

    Chunks no wider than that hold no break inside, so packets are added up by chunk, and chunks into sessions: all
    that is shuffled are those sums, once by chunk and once by flow. ``keep`` may store them in between.
    """
    gap_us = _micros(timeout_s)
    rows = canonical_flow(packets).withColumn(CHUNK, chunk_of("ts_us", run_width(gap_us, None)))
    sums = _by_tag(rows, [*KEY, CHUNK])
    sums = keep(sums) if keep else sums
    # a chunk has a row per tag
    flow = Window.partitionBy(*KEY).orderBy(CHUNK)
    before = flow.rangeBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_from": F.min("_first").over(Window.partitionBy(*KEY, CHUNK)), "_prev": F.max("_last").over(before)})
    apart = F.lit(False) if gap_us is None else F.col("_from") - F.col("_prev") > gap_us
    sums = sums.withColumn("_new", F.when(F.col("_prev").isNull() | apart, F.col("_from")))
    sums = sums.withColumn("session_us", F.max("_new").over(flow.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    group = [*KEY, "session_us"]
    return _basic(_merged(sums, group), group)


def flow_vector51(
    packets: DataFrame,
    timeout_s: float | None = 300,
    subflow_gap_s: float = 1.0,
    idle_gap_s: float = 5.0,
) -> DataFrame:
    """The 51 features per session; forward is the direction of the session's first packet.

    Sessions and active periods break between chunks only (see ``ordered``), so what a packet has to know of earlier ones
    is in its chunk's carry row; one window over (flow, chunk) gives gaps and per-direction gaps.
    """
    gap_us, idle_us = _micros(timeout_s), _micros(idle_gap_s)
    width = run_width(gap_us, min(idle_us, WIDTH_US))
    packets = canonical_flow(packets).withColumns(
        {"_a": is_forward(), "_plen": F.coalesce(F.col("payload_len"), F.octet_length("payload"), F.lit(0))}
    )
    ts = F.col("ts_us")
    spans = runs(packets, KEY, "ts_us", gap_us, width, last_a=F.max(F.when(F.col("_a"), ts)), last_b=F.max(F.when(~F.col("_a"), ts)))
    before, upto = earlier(KEY), Window.partitionBy(*KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("wakes", F.col("is_new") | (F.col("from_at") - F.col("prev_at") > idle_us))
    woken = F.when(F.col("wakes"), F.col("from_at"))
    carry = spans.select(
        *KEY, CHUNK, F.col("prev_at").alias("_at"), F.max("last_a").over(before).alias("_at_a"), F.max("last_b").over(before).alias("_at_b"),
        F.struct("is_new", "wakes", F.col("run_at").alias("session_us"), F.max(woken).over(upto).alias("active_us"), F.max(woken).over(before).alias("active_before")).alias("_span"),
    )
    rows = packets.withColumns(
        {CHUNK: chunk_of("ts_us", width), "_at": ts, "_at_a": F.when(F.col("_a"), ts), "_at_b": F.when(~F.col("_a"), ts)}
    )
    order = Window.partitionBy(*KEY, CHUNK).orderBy(ROW, *ORDER)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = with_carry(rows, carry).withColumns(
        {
            "_prev": F.lag("_at").over(order),
            "_leads": F.row_number().over(order) == 2,
            "_span": F.first("_span").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_last_a": F.max("_at_a").over(past),
            "_last_b": F.max("_at_b").over(past),
        }
    ).filter(F.col(ROW) == 1)
    rows = rows.withColumns({"_new": F.col("_leads") & F.col("_span.is_new"), "_wakes": F.col("_leads") & F.col("_span.wakes"), "session_us": F.col("_span.session_us"), "_active_us": F.col("_span.active_us")})
    gap = F.when(~F.col("_new"), ts - F.col("_prev"))
    last = F.when(F.col("_a"), F.col("_last_a")).otherwise(F.col("_last_b"))
    resumed = ~F.col("_new") & F.col("_wakes")
    df = rows.withColumns(
        {
            "_iat": F.when(last >= F.col("session_us"), _seconds(ts - last)),
            "_idle": F.when(resumed, _seconds(gap)),
            "_active": F.when(resumed, _seconds(F.col("_prev") - F.col("_span.active_before"))),
        }
    )
    place = F.struct("ts_us", "packet_number")
    length, plen = F.col("length"), F.col("_plen")

    def side(p: str, cond: Column) -> list[Column]:
        def on(c: Column) -> Column:
            return F.when(cond, c)

        return [
            _count(cond).alias(f"{p}packets"),
            F.coalesce(F.sum(on(length.cast("long"))), F.lit(0)).alias(f"{p}bytes"),
            F.coalesce(F.sum(on(plen.cast("long"))), F.lit(0)).alias(f"{p}payload_bytes"),
            F.max(on(length)).alias(f"{p}packet_len_max"),
            F.min(on(length)).alias(f"{p}packet_len_min"),
            F.avg(on(length)).alias(f"{p}packet_len_mean"),
            F.stddev_pop(on(length)).alias(f"{p}packet_len_std"),
            _seconds(F.max(on(ts)) - F.min(on(ts))).alias(f"{p}iat_total"),
            F.avg(on(F.col("_iat"))).alias(f"{p}iat_mean"),
            F.stddev_pop(on(F.col("_iat"))).alias(f"{p}iat_std"),
            F.max(on(F.col("_iat"))).alias(f"{p}iat_max"),
            F.min(on(F.col("_iat"))).alias(f"{p}iat_min"),
            F.min_by(on(F.col("window")), F.when(cond & F.col("window").isNotNull(), place)).alias(f"{p}win"),
        ]

    a, b = F.col("_a"), ~F.col("_a")
    agg = df.groupBy(*KEY, "session_us").agg(
        F.max("ts_us").alias("_end"),
        F.max("_active_us").alias("_last_active"),
        F.min_by("_a", place).alias("_a_first"),
        *side("a_", a),
        *side("b_", b),
        *[_count(_flag(n)).alias(f"{n.lower()}_flag_count") for n, _ in TCP_FLAGS],
        (_count(gap > F.lit(int(subflow_gap_s * MICRO))) + 1).alias("_subflows"),
        *[f(c).alias(f"_{c[1:]}_{n}") for c in ("_idle", "_active") for n, f in _STATS.items()],
    )
    return _vector_columns(agg)


_STATS = {"n": F.count, "sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}


def _vector_columns(agg: DataFrame) -> DataFrame:
    """Orient both directions, close the last active period and name the 51 columns."""
    first_is_a = F.col("_a_first")
    zero = F.lit(0.0)
    duration = F.greatest(_seconds(F.col("_end") - F.col("session_us")), F.lit(0.001))
    cols: dict[str, Column] = {"duration": duration}
    measures = (
        "packets", "bytes", "payload_bytes", "packet_len_max", "packet_len_min", "packet_len_mean",
        "packet_len_std", "iat_total", "iat_mean", "iat_std", "iat_max", "iat_min", "win",
    )
    oriented = {}
    for d, (x, y) in {"fwd": ("a_", "b_"), "bwd": ("b_", "a_")}.items():
        for m in measures:
            value = F.when(first_is_a, F.col(x + m)).otherwise(F.col(y + m))
            oriented[d, m] = F.coalesce(value, F.lit(0))
    for d in ("fwd", "bwd"):
        for m in measures[:-1]:
            v = oriented[d, m]
            cols[f"{d}_{m}"] = v if m in ("packets", "bytes", "payload_bytes") else v.cast("double")
        cols[f"{d}_packets_per_sec"] = oriented[d, "packets"] / duration
        cols[f"{d}_bytes_per_sec"] = oriented[d, "bytes"] / duration
        for m in ("packets", "bytes"):
            cols[f"subflow_{d}_{m}"] = F.floor(oriented[d, m] / F.col("_subflows"))
        cols[f"init_{d}_win_bytes"] = oriented[d, "win"].cast("long")
    for n, _ in TCP_FLAGS:
        cols[f"{n.lower()}_flag_count"] = F.col(f"{n.lower()}_flag_count")
    for n in ("mean", "std", "max", "min"):
        cols[f"idle_{n}"] = F.coalesce(F.col(f"_idle_{n}"), zero)
    # the period still open at the end of the session joins the closed ones
    tail = _seconds(F.col("_end") - F.col("_last_active"))
    n = F.col("_active_n")
    mean = F.coalesce(F.col("_active_mean"), zero)
    new_mean = (F.coalesce(F.col("_active_sum"), zero) + tail) / (n + 1)
    spread = n * F.pow(F.coalesce(F.col("_active_std"), zero), F.lit(2.0)) + (tail - mean) * (tail - new_mean)
    cols["active_mean"] = new_mean
    cols["active_std"] = F.sqrt(F.greatest(spread / (n + 1), zero))
    cols["active_max"] = F.greatest(F.col("_active_max"), tail)
    cols["active_min"] = F.least(F.col("_active_min"), tail)

    def end(a: str, b: str) -> Column:
        return F.when(first_is_a, F.col(a)).otherwise(F.col(b))

    src, dst, sport, dport = end("ip1", "ip2"), end("ip2", "ip1"), end("port1", "port2"), end("port2", "port1")
    return agg.select(
        flow_id().alias("flow_id"),
        F.concat(src, F.lit(":"), sport, F.lit("->"), dst, F.lit(":"), dport, F.lit("/"), F.col("protocol")).alias("flow_key"),
        _seconds(F.col("session_us")).alias("timestamp"),
        src.alias("src_ip"),
        dst.alias("dst_ip"),
        sport.alias("src_port"),
        dport.alias("dst_port"),
        F.col("protocol"),
        *[cols[n].alias(n) for n in FEATURES],
    ).withColumn("features", F.array(*[F.col(n).cast("double") for n in FEATURES]))


def inter_arrival(packets: DataFrame) -> DataFrame:
    """Packets with ``forward`` and ``iat_s``, the gap to the previous one of the same direction."""
    flows = Ordered(canonical_flow(packets).withColumn("forward", is_forward()), KEY, ORDER)
    ts, fwd = F.col("ts_us"), F.col("forward")
    flows.running(inclusive=False, _f=("max", F.when(fwd, ts)), _b=("max", F.when(~fwd, ts)))
    last = F.when(fwd, F.col("_f")).otherwise(F.col("_b"))
    return flows.result().withColumns({"flow_id": flow_id(), "iat_s": _seconds(ts - last)}).drop("_f", "_b")


def active_idle(packets: DataFrame, idle_gap_s: float = 5.0) -> DataFrame:
    """Active periods of each flow (one row each) with the idle time before them."""
    periods = runs(canonical_flow(packets), KEY, "ts_us", _micros(idle_gap_s))
    agg = periods.groupBy(*KEY, F.col("run_at").alias("period_us")).agg(
        F.max("to_at").alias("_end"),
        F.sum("n").alias("packets"),
        F.max(F.when(F.col("is_new"), F.col("from_at") - F.col("prev_at"))).alias("_idle"),
    )
    return agg.select(
        flow_id().alias("flow_id"),
        "period_us",
        "packets",
        _seconds(F.col("_end") - F.col("period_us")).alias("active_s"),
        _seconds(F.col("_idle")).alias("idle_before_s"),
    )


def match_bidirectional(exports: DataFrame) -> DataFrame:
    """One-way flow exports paired by canonical key; an unmatched side counts zero."""
    df = canonical_flow(exports).withColumn("_fwd", is_forward())
    fwd = F.col("_fwd")

    def total(c: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    return df.groupBy(*KEY).agg(
        F.min("flow_start").alias("flow_start"),
        F.max("flow_end").alias("flow_end"),
        _count(fwd).alias("fwd_records"),
        _count(~fwd).alias("rev_records"),
        total("packets", fwd).alias("fwd_packets"),
        total("packets", ~fwd).alias("rev_packets"),
        total("bytes", fwd).alias("fwd_bytes"),
        total("bytes", ~fwd).alias("rev_bytes"),
        F.bit_or(F.col("tcp_flags")).alias("tcp_flags"),
    ).withColumn("matched", (F.col("fwd_records") > 0) & (F.col("rev_records") > 0))


def export_features(exports: DataFrame) -> DataFrame:
    """Bidirectional flow exports as flow features (no packet sizes or payload exist here)."""
    df = match_bidirectional(exports).withColumns(
        {
            "duration": F.greatest(F.col("flow_end") - F.col("flow_start"), F.lit(0.001)),
            "packets_total": F.col("fwd_packets") + F.col("rev_packets"),
            "bytes_total": F.col("fwd_bytes") + F.col("rev_bytes"),
        }
    )
    return df.select(
        flow_id().alias("flow_id"),
        F.col("ip1").alias("src_ip"),
        F.col("ip2").alias("dst_ip"),
        F.col("port1").alias("src_port"),
        F.col("port2").alias("dst_port"),
        "protocol",
        F.col("flow_start").alias("start_time"),
        "duration",
        "packets_total",
        "bytes_total",
        F.col("fwd_packets").alias("packets_fwd"),
        F.col("rev_packets").alias("packets_rev"),
        F.col("fwd_bytes").alias("bytes_fwd"),
        F.col("rev_bytes").alias("bytes_rev"),
        (F.col("packets_total") / F.col("duration")).alias("packets_per_sec"),
        (F.col("bytes_total") / F.col("duration")).alias("bytes_per_sec"),
        (F.col("bytes_total") / F.greatest(F.col("packets_total"), F.lit(1))).alias("avg_pkt_size"),
        (F.col("fwd_packets") / F.greatest(F.col("rev_packets"), F.lit(1))).alias("fwd_rev_packet_ratio"),
        (F.col("fwd_bytes") / F.greatest(F.col("rev_bytes"), F.lit(1))).alias("fwd_rev_byte_ratio"),
    )
