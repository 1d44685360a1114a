"""Record types and the fixed name lists every other module shares."""

from __future__ import annotations

# --- fixed values: the ordered 51-feature vector --------------------------------
FEATURES = (
    "duration",
    "fwd_packets",
    "bwd_packets",
    "fwd_bytes",
    "bwd_bytes",
    "fwd_payload_bytes",
    "bwd_payload_bytes",
    "fwd_packet_len_max",
    "fwd_packet_len_min",
    "fwd_packet_len_mean",
    "fwd_packet_len_std",
    "bwd_packet_len_max",
    "bwd_packet_len_min",
    "bwd_packet_len_mean",
    "bwd_packet_len_std",
    "fwd_iat_total",
    "fwd_iat_mean",
    "fwd_iat_std",
    "fwd_iat_max",
    "fwd_iat_min",
    "bwd_iat_total",
    "bwd_iat_mean",
    "bwd_iat_std",
    "bwd_iat_max",
    "bwd_iat_min",
    "fin_flag_count",
    "syn_flag_count",
    "rst_flag_count",
    "psh_flag_count",
    "ack_flag_count",
    "urg_flag_count",
    "cwr_flag_count",
    "ece_flag_count",
    "fwd_packets_per_sec",
    "bwd_packets_per_sec",
    "fwd_bytes_per_sec",
    "bwd_bytes_per_sec",
    "subflow_fwd_packets",
    "subflow_fwd_bytes",
    "subflow_bwd_packets",
    "subflow_bwd_bytes",
    "init_fwd_win_bytes",
    "init_bwd_win_bytes",
    "active_mean",
    "active_std",
    "active_max",
    "active_min",
    "idle_mean",
    "idle_std",
    "idle_max",
    "idle_min",
)

# --- fixed values: TCP flag bits in report order ---------------------------------
TCP_FLAGS = (
    ("FIN", 0x01),
    ("SYN", 0x02),
    ("RST", 0x04),
    ("PSH", 0x08),
    ("ACK", 0x10),
    ("URG", 0x20),
    ("ECE", 0x40),
    ("CWR", 0x80),
)

# --- fixed values: severities in rank order, their risk, alert statuses -----------
SEVERITIES = ("debug", "info", "notice", "warning", "error", "critical", "alert", "emergency")
RISK = {
    "debug": 0,
    "info": 10,
    "notice": 20,
    "warning": 40,
    "error": 60,
    "critical": 80,
    "alert": 90,
    "emergency": 100,
}
STATUSES = ("new", "acknowledged", "resolved", "closed")
SEVERITY_OF_TYPE = {
    "fast_path": "warning",
    "deep_path": "error",
    "xgboost_supervised": "critical",
}
DEDUP_FIELDS = ("alert_type", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port")

# --- record schemas (DDL) --------------------------------------------------------
PACKET = """
    ts_us BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol INT,
    length INT, payload BINARY, pcap_file STRING, packet_number BIGINT,
    tcp_flags INT, window INT, payload_len INT
"""
PACKET_JSON = """
    timestamp DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol INT,
    length INT, payload BINARY, pcap_file STRING, packet_number BIGINT,
    tcp_flags INT, window INT, payload_len INT
"""
FLOW_EXPORT = """
    flow_start DOUBLE, flow_end DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT,
    protocol INT, packets BIGINT, bytes BIGINT, input_snmp BIGINT, output_snmp BIGINT,
    src_as BIGINT, dst_as BIGINT, tcp_flags INT, exporter_ip STRING, engine_type INT,
    engine_id INT, vendor_props MAP<STRING, STRING>
"""
TEMPLATE = "exporter STRING, template_id INT, spec ARRAY<STRUCT<ftype: INT, flen: INT>>, seen_us BIGINT"
DETECTION = """
    alert_type STRING, flow_key STRING, timestamp DOUBLE, is_anomaly BOOLEAN,
    src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol INT,
    anomaly_score DOUBLE, reconstruction_error DOUBLE, anomaly_probability DOUBLE,
    confidence DOUBLE, model_version STRING, inference_time_ms DOUBLE,
    rule_id STRING, rule_name STRING, rule_severity STRING
"""
IP_INFO = """
    asn BIGINT, asn_description STRING, network STRING, country STRING, registry STRING,
    city STRING, latitude DOUBLE, longitude DOUBLE
"""
TRAINING_FLOW = """
    flow_key STRING, timestamp DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT,
    protocol INT, features MAP<STRING, DOUBLE>, label STRING
"""
TREE_NODE = """
    tree INT, node INT, split_idx INT, split_val DOUBLE, lhs INT, rhs INT, size INT
"""
