"""Record schemas and the constants that detectors share."""

from __future__ import annotations

from pyspark.sql import types as T

FLAGS = ("syn", "ack", "rst", "fin", "psh", "urg")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """A schema from "name type, ..." without needing a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


PACKET = (
    _struct("src_ip string, dst_ip string, src_port int, dst_port int, protocol int, timestamp_us long, packet_len int, payload_len long")
    .add("tcp_flags", T.StructType([T.StructField(f, T.BooleanType()) for f in FLAGS]))
    .add("dns_query", T.StringType())
    .add("ingest_time", T.StringType())
)
CONNECTION = _struct("ts_us long, src_ip string, dst_ip string, dst_port string, conn_state string, duration double, orig_pkts double, resp_pkts double, history string")
C2_FLOW = _struct(
    "ts_us long, orig_h string, resp_h string, resp_p long, proto string, orig_pkts double, resp_pkts double, local_orig boolean, duration double, orig_ip_bytes double, resp_ip_bytes double, uid string"
)
ALERT = _struct(
    "alert_id string, timestamp double, threat_class string, confidence double, severity string, src_ip string, dst_ip string, src_port int, dst_port int, flow_id string, evidence string, model_version string"
)

TCP, UDP = 6, 17
WINDOW_US = 10_000_000

# Well-known service ports of the beacon and scan rules.
STANDARD_PORTS = (22, 25, 53, 80, 110, 135, 139, 143, 443, 445, 993, 995, 3389, 8080, 8443)
# Ports that the flood vector counts as common.
COMMON_PORTS = (22, 25, 53, 80, 110, 143, 443, 993, 995, 3389, 8080, 8443)
# Ports on which encrypted-session scoring abstains.
WEB_PORTS = (80, 443, 3000, 5000, 8080, 8443)

#: Connection states that count as failed
FAILED_STATES = ("S0", "REJ")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
#: Threat classes in display order: label, short code
THREATS = {
    "DDoS": ("Denial-of-service flood", "DoS"),
    "PortScan": ("Port scanning / reconnaissance", "SCN"),
    "C2_BEACONING": ("Command-and-control beaconing", "C2"),
    "DataExfiltration": ("Possible data theft", "EXF"),
    "EncryptedMalware": ("Encrypted malware traffic", "ENC"),
    "DGA": ("Suspicious auto-generated domains", "DGA"),
}
MODEL_VERSION = "1.0.0"
