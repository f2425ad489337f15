"""DuckDB SQL for the registered queries, over the benchmark tables.

Written apart from the DataFrame code, so that the two check each other. Views and
shared steps are common table expressions that a query names in ``needs``.
"""

from __future__ import annotations

from trafficlens.functions import domains as D

AS_OF_US = 1706659200000000
START_US = 1704067200000000

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "flows_v": ((), """select l_orderkey*8+l_linenumber as seq,
      epoch_us(l_shipdate)//86400 + ((l_orderkey*8+l_linenumber)%1000)*1000 as ts_us,
      '10.0.'||cast(l_suppkey//256 as varchar)||'.'||cast(l_suppkey%256 as varchar) as src_ip,
      '172.16.0.'||cast(l_partkey%40 as varchar) as dst_ip, cast(l_partkey%1024 as varchar) as dst_port,
      case l_returnflag||l_linestatus when 'AF' then 'SF' when 'AO' then 'S0' when 'NF' then 'REJ' when 'NO' then 'RSTO' when 'RF' then 'OTH' else 'S1' end as conn_state,
      cast(l_linenumber as double)/8 as duration, cast(l_quantity as double) as orig_pkts,
      case when l_linestatus='O' then cast(0 as double) else cast(l_linenumber as double) end as resp_pkts,
      case when l_returnflag='A' and l_linestatus='O' and l_quantity<=25 then 'S' else '-' end as history from lineitem"""),
    "packets_v": ((), """select event_id as seq, 1704067200000000 + (epoch_us(ts)-1704067200000000)//100000 as timestamp_us,
      case when event_id%3=0 then srv else cli end as src_ip, case when event_id%3=0 then cli else srv end as dst_ip,
      case when event_id%3=0 then sp else cp end as src_port, case when event_id%3=0 then cp else sp end as dst_port,
      case when user_id%5=0 then 17 else 6 end as protocol, 60+cast(floor(value) as int) as packet_len,
      event_type='signup' as syn, event_type in ('view','click','purchase') as ack, event_type='error' as rst, event_type='purchase' as fin, event_type in ('click','purchase') as psh
      from (select *, '10.1.'||cast(user_id // 256 as varchar)||'.'||cast(user_id%256 as varchar) as cli, '203.0.113.'||cast(k%2 as varchar) as srv,
        cast(40000+user_id%20000 as int) as cp, case when k%2=0 then 443 else 9001 end as sp from (select *, cast(json_extract(props,'$.k') as int) as k from events) e) f"""),
    "alerts_v": ((), """select event_id as seq, cast(event_id as varchar) as alert_id, epoch_us(ts) as ts_us,
      case k%6 when 0 then 'DDoS' when 1 then 'PortScan' when 2 then 'C2_BEACONING' when 3 then 'DataExfiltration' when 4 then 'EncryptedMalware' else 'DGA' end as threat_class,
      cast(700+3*k as double)/1000 as confidence,
      case when k>=94 then 'CRITICAL' when k>=67 then 'HIGH' when k>=34 then 'MEDIUM' else 'LOW' end as severity,
      '10.1.'||cast(user_id // 256 as varchar)||'.'||cast(user_id%256 as varchar) as src_ip, '203.0.113.'||cast(k%20 as varchar) as dst_ip, 0 as src_port, k as dst_port
      from (select *, cast(json_extract(props,'$.k') as int) as k from events) e"""),
    "domains_v": ((), "select page_id as seq, lower(regexp_extract(url,'^[a-z]+://([^/?#:]+)',1)) as domain from pages"),
    "c2_flows_v": ((), """select l_orderkey*8+l_linenumber as seq, epoch_us(l_shipdate)//86400 + ((l_orderkey*8+l_linenumber)%1000)*1000 as ts_us,
      '147.32.'||cast(l_suppkey // 256 as varchar)||'.'||cast(l_suppkey%256 as varchar) as orig_h, '172.16.0.'||cast(l_partkey%4 as varchar) as resp_h, cast(443 as bigint) as resp_p, 'tcp' as proto,
      cast(l_quantity as bigint)+cast(l_linenumber as bigint) as pkts, cast(l_linenumber as double)/8 as dur, cast(floor(l_extendedprice) as bigint) + cast(l_partkey%997 as bigint) as bytes from lineitem"""),
    "keyed": (("packets_v",), """select *, (timestamp_us // 10000000) * 10000000 as window_us,
      least(src_ip||':'||src_port, dst_ip||':'||dst_port)||'-'||greatest(src_ip||':'||src_port, dst_ip||':'||dst_port)||'-'||protocol as flow_key from packets_v"""),
    "ways": (("keyed",), """select *, src_ip = f_src and src_port = f_sport as fwd from (select *,
      first_value(src_ip) over w as f_src, first_value(src_port) over w as f_sport, first_value(dst_ip) over w as f_dst, first_value(dst_port) over w as f_dport
      from keyed window w as (partition by window_us, flow_key order by timestamp_us, seq))"""),
    "gaps": (("ways",), """select *, case when g > 0 then g end as gap from (select *, timestamp_us - lag(timestamp_us) over (partition by window_us, flow_key, fwd order by timestamp_us, seq) as g from ways)"""),
    "flows": (("gaps",), """select *, greatest((last_us - start_us) / 1e6, 0.001) as duration, fwd_packets + bwd_packets as total_packets, fwd_bytes + bwd_bytes as total_bytes from (
      select window_us, flow_key, min(protocol) as protocol, min(f_src) as src_ip, min(f_sport) as src_port, min(f_dst) as dst_ip, min(f_dport) as dst_port, min(timestamp_us) as start_us, max(timestamp_us) as last_us,
      count(*) filter (syn) as syn_count, count(*) filter (ack) as ack_count, count(*) filter (rst) as rst_count, count(*) filter (fin) as fin_count, count(*) filter (psh) as psh_count,
      count(*) filter (fwd) as fwd_packets, count(*) filter (not fwd) as bwd_packets,
      cast(coalesce(sum(packet_len) filter (fwd), 0) as bigint) as fwd_bytes, cast(coalesce(sum(packet_len) filter (not fwd), 0) as bigint) as bwd_bytes,
      coalesce(avg(packet_len) filter (fwd), 0) as fwd_size_mean, coalesce(avg(packet_len) filter (not fwd), 0) as bwd_size_mean,
      coalesce(stddev_pop(packet_len) filter (fwd), 0) as fwd_size_std, coalesce(stddev_pop(packet_len) filter (not fwd), 0) as bwd_size_std,
      coalesce(max(packet_len) filter (fwd), 0) as fwd_size_max, coalesce(max(packet_len) filter (not fwd), 0) as bwd_size_max,
      count(gap) filter (fwd) as fwd_gaps, count(gap) filter (not fwd) as bwd_gaps, avg(gap) filter (fwd) / 1e6 as fwd_gap_mean, avg(gap) filter (not fwd) / 1e6 as bwd_gap_mean,
      coalesce(stddev_pop(gap) filter (fwd) / 1e6, 0) as fwd_gap_std, coalesce(stddev_pop(gap) filter (not fwd) / 1e6, 0) as bwd_gap_std,
      avg(packet_len) as size_mean, stddev_pop(packet_len) as size_std, var_pop(packet_len) as size_var, max(packet_len) as size_max, min(packet_len) as size_min,
      coalesce(avg(gap) / 1e6, 0) as gap_mean, coalesce(stddev_pop(gap) / 1e6, 0) as gap_std, coalesce(max(gap) / 1e6, 0) as gap_max, coalesce(min(gap) / 1e6, 0) as gap_min
      from gaps group by window_us, flow_key)"""),
    "rates": (("flows",), """select *, total_bytes / duration as bytes_per_sec, total_packets / duration as pkts_per_sec, fwd_bytes / greatest(fwd_packets, 1) as fwd_bytes_per_pkt, bwd_bytes / greatest(bwd_packets, 1) as bwd_bytes_per_pkt,
      coalesce(fwd_gap_mean, duration) as fwd_iat_mean, fwd_gap_std as fwd_iat_std, coalesce(bwd_gap_mean, duration) as bwd_iat_mean, bwd_gap_std as bwd_iat_std,
      fwd_bytes / greatest(total_bytes, 1) as bytes_ratio, fwd_packets / greatest(total_packets, 1) as pkt_ratio, syn_count / total_packets as syn_ratio, ack_count / total_packets as ack_ratio, rst_count / total_packets as rst_ratio,
      fin_count / total_packets as fin_ratio, psh_count / total_packets as psh_ratio, bwd_bytes / greatest(fwd_bytes, 1) as down_up_ratio, case when dst_port = 443 then 1 else 0 end as is_std_https,
      case when dst_port > 1024 and dst_port not in (443, 8443, 8080) then 1 else 0 end as is_high_port from flows"""),
    "loads": (("flows",), """select *, greatest((last_us - first_us) / 1e6, 0.001) as duration, packets / greatest((last_us - first_us) / 1e6, 0.001) as packet_rate from (
      select window_us, dst_ip, cast(sum(total_packets) as bigint) as packets, cast(sum(total_bytes) as bigint) as bytes, cast(sum(fwd_bytes) as bigint) as fwd_bytes, cast(sum(bwd_bytes) as bigint) as bwd_bytes, count(*) as flows,
      cast(sum(syn_count) as bigint) as syn_count, count(distinct dst_port) as unique_dst_ports, cast(sum(bwd_packets) as bigint) as response_packets, min(start_us) as first_us, max(last_us) as last_us,
      arg_min(src_ip, lpad(cast(start_us as varchar), 20, '0')||flow_key) as src_ip, arg_min(dst_port, lpad(cast(start_us as varchar), 20, '0')||flow_key) as dst_port
      from flows where protocol = 6 group by window_us, dst_ip)"""),
    "floods": (("loads",), """select *, case when is_flood then case when flows >= 500 or packet_rate >= 2000 then 0.99 else least(0.90 + least(packet_rate / 5000, 0.09), 0.99) end end as confidence from (
      select *, unique_dst_ports >= 20 as scan_shaped, unique_dst_ports < 20 and not (flows <= 3 and fwd_bytes > 100000 and fwd_bytes > 4 * greatest(bwd_bytes, 1))
        and ((packets >= 500 and packet_rate >= 200 and flows >= 10) or (flows >= 200 and duration < 15 and unique_dst_ports <= 5)) as is_flood from loads)"""),
    "sessions": (("flows",), """select *, sessions >= 3 and fwd_bytes / sessions >= 500 and bytes / sessions >= 700 and psh / sessions >= 3 as is_encrypted_malware from (
      select window_us, src_ip, dst_ip, dst_port, count(*) as sessions, cast(sum(total_bytes) as bigint) as bytes, cast(sum(fwd_bytes) as bigint) as fwd_bytes, cast(sum(psh_count) as bigint) as psh, cast(sum(total_packets) as bigint) as packets
      from flows where protocol = 6 and bwd_packets > 0 and dst_port > 1024 and dst_port not in (22,25,53,80,110,135,139,143,443,445,993,995,3389,8080,8443) group by all)"""),
    "starts": (("packets_v",), """select (timestamp_us // 10000000) * 10000000 as window_us, src_ip, dst_ip, dst_port, timestamp_us, seq from packets_v
      where protocol = 6 and syn and not ack and dst_port > 1024 and dst_port not in (22,25,53,80,110,135,139,143,443,445,993,995,3389,8080,8443)
      and not (src_ip like '%.255' or src_ip like '%.0' or src_ip like '224.%' or src_ip like '239.%' or src_ip like '127.%' or src_ip like '162.159.%' or src_ip like '104.16.%')"""),
    "endpoints": (("flows",), """select window_us, src_ip, dst_ip, dst_port, cast(sum(bwd_packets) as bigint) as response_packets, cast(sum(total_bytes) as bigint) as bytes, cast(sum(total_packets) as bigint) as packets,
      sum(last_us - start_us) / 1e6 as duration, count(*) as flows, cast(sum(rst_count) as bigint) as rst_count, count(*) filter (psh_count > 0 and bwd_packets > 0) as established,
      cast(coalesce(sum(total_bytes) filter (psh_count > 0 and bwd_packets > 0), 0) as bigint) as data_bytes from flows where protocol = 6 group by 1, 2, 3, 4"""),
    "claimed": (("floods", "sessions"), """select distinct window_us, kind, ip from (select window_us, 'dst' as kind, dst_ip as ip from floods where is_flood
      union all select window_us, 'src', src_ip from floods where scan_shaped union all select window_us, 'dst', dst_ip from sessions where is_encrypted_malware)"""),
    "scan_rows": (("flows_v",), """select f.*, s.start_us from flows_v f, unnest(range(0, 3)) as k(i), lateral (select (ts_us // 10000000) * 10000000 - i * 10000000 as start_us) s"""),
    "scan_rows_10_2": (("flows_v",), """select f.*, s.start_us from flows_v f, unnest(range(0, 5)) as k(i), lateral (select (ts_us // 2000000) * 2000000 - i * 2000000 as start_us) s"""),
    "units_60": (("c2_flows_v",), "select *, (ts_us // 60000000) * 60000000 as start_us from c2_flows_v"),
    "origin": (("c2_flows_v",), "select (min(ts_us) // 1000000) * 1000000 as o from c2_flows_v"),
    "units_60_10": (("c2_flows_v", "origin"), "select * from (select f.*, ((ts_us - o) // 10000000) * 10000000 + o - i * 10000000 as start_us, o from c2_flows_v f, origin, unnest(range(0, 6)) as k(i)) where start_us >= o"),
    "units_300_60": (("c2_flows_v", "origin"), "select * from (select f.*, ((ts_us - o) // 60000000) * 60000000 + o - i * 60000000 as start_us, o from c2_flows_v f, origin, unnest(range(0, 5)) as k(i)) where start_us >= o"),
}


def q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def qs(names: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{q(n.strip())} as {n.strip()}" for n in names.split(","))


def sql(needs: str, body: str, extra: tuple[tuple[str, str], ...] = (), view: dict[str, str] | None = None) -> str:
    """A query over the named common table expressions and what they need; ``view`` has other text for some."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTE[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} as ({(view or {}).get(n, CTE[n][1])})" for n in order] + [f"{n} as ({b})" for n, b in extra]
    return f"with {', '.join(parts)} {body}" if parts else body


def _portscan(rows: str, window_s: int) -> str:
    return sql(rows, f"""select t.*, p.unique_dst_ports, max_hosts_on_single_port, dst_port_entropy, unique_dst_hosts, max_ports_to_single_host,
      {q('p.unique_dst_ports / unique_dst_hosts')} as ports_per_host, {q('p.unique_dst_ports / connection_attempts')} as fanout_ratio, t.start_us + {window_s * 1000000} as end_us
      from totals t join ports p using (src_ip, start_us) join hosts using (src_ip, start_us)""", (
        ("gapped", f"select *, ts_us - lag(ts_us) over (partition by src_ip, start_us order by ts_us) as gap from {rows}"),
        ("totals", f"""select src_ip, start_us, count(*) as connection_attempts, count(*) filter (conn_state in ('S0', 'REJ')) as failed_connections, {q(f'count(*) / {window_s}')} as connections_per_sec,
          {q("count(*) filter (conn_state in ('S0', 'REJ')) / count(*)")} as failed_conn_ratio, {q("count(*) filter (conn_state = 'S0') / count(*)")} as s0_ratio, {q("count(*) filter (conn_state = 'REJ') / count(*)")} as rej_ratio,
          {q("count(*) filter (conn_state = 'RSTO') / count(*)")} as rsto_ratio, case when sum(orig_pkts) <> 0 then {q('sum(resp_pkts) / sum(orig_pkts)')} else 0 end as resp_ratio, {q('count(*) filter (resp_pkts = 0) / count(*)')} as zero_resp_ratio,
          {q('(sum(orig_pkts) + sum(resp_pkts)) / count(*)')} as avg_pkts_per_conn, {q('avg(duration)')} as avg_duration, {q('coalesce(case when avg(gap) > 0 then stddev_pop(gap) / avg(gap) end, 0)')} as iat_cv,
          {q("count(*) filter (history = 'S') / count(*)")} as syn_only_ratio, {q(f'case when max(ts_us) > min(ts_us) then count(*) / ((max(ts_us) - min(ts_us)) / 1e6) else count(*) / {window_s} end', 4)} as scan_rate
          from gapped group by src_ip, start_us having count(*) >= 5"""),
        ("by_port", f"select src_ip, start_us, dst_port, count(*) as c, count(distinct dst_ip) as hosts from {rows} group by 1, 2, 3"),
        ("ports", f"select src_ip, start_us, count(*) as unique_dst_ports, max(hosts) as max_hosts_on_single_port, {q('abs(log2(sum(c)) - sum(c * log2(c)) / sum(c))')} as dst_port_entropy from by_port group by 1, 2"),
        ("hosts", f"select src_ip, start_us, count(*) as unique_dst_hosts, max(n) as max_ports_to_single_host from (select src_ip, start_us, dst_ip, count(distinct dst_port) as n from {rows} group by 1, 2, 3) group by 1, 2"),
    ))


def _units(rows: str, window_s: int) -> str:
    key = "start_us, orig_h, resp_h, resp_p, proto"
    return sql(rows, f"""select u.start_us, u.orig_h, u.resp_h, u.resp_p, u.proto, endpoint_host_fanin, n_flows, {q('dst_recurrence')} as dst_recurrence, host_endpoint_fanout,
      {qs('iat_mean, iat_cov, mean_pkts, iat_madn, dur_mean, dur_cov, pkts_cov, bytes_mean')}, {q('n_flows / host_flows')} as host_flow_share
      from units u join fanin using (start_us, resp_h, resp_p, proto) join fanout using (start_us, orig_h)""", (
        ("g0", f"select *, ts_us - lag(ts_us) over (partition by {key} order by ts_us) as gap from {rows}"),
        ("g1", f"select *, median(gap) over (partition by {key}) as med from g0"),
        ("units", f"""select {key}, count(*) as n_flows, count(distinct least(greatest(floor((ts_us - start_us) / {window_s * 100000.0}), 0), 9)) / 10 as dst_recurrence, avg(gap) / 1e6 as iat_mean,
          case when count(gap) >= 2 and avg(gap) > 0 then stddev_pop(gap) / avg(gap) end as iat_cov, avg(pkts) as mean_pkts,
          case when count(gap) >= 2 and min(med) > 0 then median(abs(gap - med)) / min(med) end as iat_madn, avg(dur) as dur_mean,
          case when count(*) >= 2 and avg(dur) > 0 then stddev_samp(dur) / avg(dur) end as dur_cov, case when count(*) >= 2 and avg(pkts) > 0 then stddev_samp(pkts) / avg(pkts) end as pkts_cov, avg(bytes) as bytes_mean
          from g1 group by {key}"""),
        ("fanin", "select start_us, resp_h, resp_p, proto, count(*) as endpoint_host_fanin from units group by 1, 2, 3, 4"),
        ("fanout", "select start_us, orig_h, count(*) as host_endpoint_fanout, sum(n_flows) as host_flows from units group by 1, 2"),
    ))


_LABEL = "split_part(domain, '.', 1)"
_CLASSES = ("DDoS", "PortScan", "C2_BEACONING", "DataExfiltration", "EncryptedMalware", "DGA")
_PER_CLASS = ", ".join(f"count(*) filter (threat_class = '{c}') as {c.lower()}" for c in _CLASSES)
_RANK = "case severity when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end"
_ALERT = "alert_id, ts_us, threat_class, confidence, severity, src_ip, dst_ip, dst_port"
_REGULAR = "1 - least(((fwd_iat_std + bwd_iat_std) / 2) / greatest((fwd_iat_mean + bwd_iat_mean) / 2, 0.001), 1.0)"
_VOLUME = "total_bytes, fwd_bytes, bwd_bytes, fwd_packets, bwd_packets"
_RATES = "duration, bytes_per_sec, pkts_per_sec, fwd_bytes_per_pkt, bwd_bytes_per_pkt, fwd_iat_mean, fwd_iat_std, bwd_iat_mean, bwd_iat_std, bytes_ratio, pkt_ratio"
_LIVE = f"ts_us between {AS_OF_US} - 1800000000 and {AS_OF_US}"
_BIGRAMS = "th he in en nt re er an ti es on at se nd or ar al te co de to ra et ed it sa em ro st le ou ng ne io ec is la ea ic el oo ll ma go ch sh li ve ge ck".split()


def _entropy(text: str) -> str:
    return f"""(select coalesce(abs(-sum(c / n * log2(c / n))), 0.0) from (select count(*) as c, sum(count(*)) over () as n from (select unnest(string_split({text}, '')) as ch) where ch <> '' group by ch))"""


ORACLE_SQL: dict[str, str] = {
    "flow_key_agg": sql("keyed", "select window_us, flow_key, count(*) as packets, cast(sum(packet_len) as bigint) as bytes, min(timestamp_us) as start_us, max(timestamp_us) as last_us from keyed group by 1, 2"),
    "flow_direction_split": sql("flows", "select window_us, flow_key, src_ip, src_port, dst_ip, dst_port, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes from flows"),
    "flow_iat_stats": sql("flows", f"select window_us, flow_key, fwd_gaps, bwd_gaps, {qs('fwd_gap_mean, bwd_gap_mean, fwd_gap_std, bwd_gap_std, gap_mean, gap_std, gap_max, gap_min')} from flows"),
    "flow_legacy_vector": sql("flows", f"""select window_us, flow_key, {q('duration * 1e6')} as flow_duration, fwd_packets as total_fwd_packets, bwd_packets as total_bwd_packets, {q('total_bytes / duration')} as flow_bytes_per_sec, {q('total_packets / duration')} as flow_packets_per_sec,
      {', '.join(f"{q(f'gap_{s} * 1e6')} as flow_iat_{s}" for s in ('mean', 'std', 'max', 'min'))}, {q('coalesce(fwd_gap_mean, 0) * 1e6')} as fwd_iat_mean, {q('coalesce(bwd_gap_mean, 0) * 1e6')} as bwd_iat_mean,
      {q('fwd_size_mean')} as fwd_packet_len_mean, {q('bwd_size_mean')} as bwd_packet_len_mean, {q('size_var')} as packet_len_variance, {q('total_bytes / total_packets')} as avg_packet_size,
      {', '.join(f'{c}_count as {c}_flag_count' for c in ('syn', 'ack', 'rst', 'fin', 'psh'))}, {q('bwd_bytes / greatest(fwd_bytes, 1)')} as down_up_ratio, fwd_bytes, bwd_bytes from flows"""),
    "flow_ddos31": sql("rates", f"""select window_us, flow_key, {_VOLUME}, total_packets, {qs(_RATES)}, {qs('size_mean, size_std, syn_ratio, ack_ratio, rst_ratio, fin_ratio, psh_ratio, down_up_ratio')}, size_max, size_min, syn_count, dst_port,
      case when dst_port in (22,25,53,80,110,143,443,993,995,3389,8080,8443) then 1 else 0 end as is_common_port, case when duration < 0.1 then 0 when duration < 1 then 1 when duration < 10 then 2 else 3 end as duration_bucket from rates where total_packets >= 5"""),
    "flow_exfil29": sql("rates", f"""select window_us, flow_key, {_VOLUME}, {qs(_RATES)}, {q('fwd_size_std')} as fwd_pkt_size_std, {q('bwd_size_std')} as bwd_pkt_size_std, {q(_REGULAR)} as iat_regularity, {q('fwd_bytes / greatest(bwd_bytes, 1)')} as up_down_ratio, dst_port, is_std_https, is_high_port,
      {qs('syn_ratio, ack_ratio, psh_ratio, fin_ratio')}, {q('fwd_packets / duration')} as fwd_burst_rate, {q('bwd_packets / greatest(fwd_packets, 1)')} as response_ratio from rates where protocol = 6 and total_packets >= 3 and fwd_bytes >= 1000"""),
    "flow_encmal31": sql("rates", f"""select window_us, flow_key, {_VOLUME}, total_packets, {qs(_RATES)}, {q('fwd_size_std')} as fwd_pkt_size_std, {q('bwd_size_std')} as bwd_pkt_size_std, fwd_size_max as fwd_pkt_size_max, bwd_size_max as bwd_pkt_size_max,
      {q(f'case when (fwd_iat_mean + bwd_iat_mean) / 2 < 0.1 then 0.0 else {_REGULAR} end')} as iat_regularity, dst_port, is_std_https, is_high_port, {qs('syn_ratio, ack_ratio, psh_ratio, rst_ratio, fin_ratio, down_up_ratio')}
      from rates where protocol = 6 and total_packets >= 6"""),
    "source_profile": sql("packets_v", f"""select (timestamp_us // 10000000) * 10000000 as window_us, src_ip, count(distinct dst_port) as unique_dst_ports, count(distinct dst_ip) as unique_dst_ips, count(*) as packets, count(*) filter (syn) as syn_count, count(*) filter (rst) as rst_count,
      {q('count(*) filter (syn) / count(*)')} as syn_ratio, {q('count(*) filter (rst) / count(*)')} as rst_ratio, {q('log2(count(distinct dst_port))')} as port_entropy, {q('stddev_pop(packet_len)')} as packet_len_std, {q('count(*) / 10')} as packets_per_sec from packets_v group by 1, 2"""),
    "dst_flood_agg": sql("loads", f"select window_us, dst_ip, packets, bytes, flows, syn_count, unique_dst_ports, response_packets, src_ip, dst_port, {qs('duration, packet_rate')} from loads"),
    "ddos_rule_alerts": sql("floods", f"select window_us, dst_ip, src_ip, scan_shaped, is_flood, {q('confidence')} as confidence, case when is_flood then case when confidence >= 0.97 then 'CRITICAL' when confidence >= 0.93 then 'HIGH' else 'MEDIUM' end end as severity from floods"),
    "encmal_session_agg": sql("sessions", f"select window_us, src_ip, dst_ip, dst_port, sessions, bytes, fwd_bytes, psh, packets, {q('bytes / sessions')} as bytes_per_session, {q('psh / sessions')} as psh_per_session, is_encrypted_malware from sessions"),
    "exfil_rule_alerts": sql("flows", f"""select window_us, flow_key, fwd_bytes, bwd_bytes, {q('up')} as up_down_ratio, confidence, confidence >= 0.98997 as is_exfiltration, case when confidence >= 0.99 then 'CRITICAL' when confidence >= 0.95 then 'HIGH' when confidence >= 0.90 then 'MEDIUM' else 'LOW' end as severity from (
      select *, case when fwd_bytes > 500000 and up > 5 then 0.995 when fwd_bytes > 100000 and up > 10 then 0.992 else 0.0 end::double as confidence from (select *, fwd_bytes / greatest(bwd_bytes, 1) as up from flows where protocol = 6 and total_packets >= 3 and fwd_bytes >= 1000))"""),
    "endpoint_summary": sql("endpoints", f"select * exclude (duration), {q('duration')} as duration from endpoints"),
    "syn_events": sql("starts", "select window_us, src_ip, dst_ip, dst_port, timestamp_us, seq from starts"),
    "c2_beacon_score": f"""with e as (select user_id, event_type, epoch_us(ts) / 1e8 as ts, event_id as seq, cast(floor(value) as bigint) as bytes from events),
      r as (select *, sum(bytes) over (partition by user_id) as total, row_number() over (partition by user_id order by ts desc, seq desc) as rank from e),
      g as (select *, ts - lag(ts) over (partition by user_id order by ts, seq) as gap from r where rank <= 256),
      s as (select user_id, count(*) as beacon_count, max(ts) - min(ts) as span, count(gap) filter (gap between 1 and 900) as n_gaps, avg(gap) filter (gap between 1 and 900) as mean_interval, stddev_pop(gap) filter (gap between 1 and 900) as interval_std, cast(min(total) as bigint) as total_bytes from g group by user_id)
      select user_id, beacon_count, n_gaps, {q('mean_interval')} as mean_interval, {q('cv')} as cv, {q('confidence')} as confidence, total_bytes,
      coalesce(beacon_count >= 5 and span <= 3600 and n_gaps >= 4 and mean_interval >= 1 and total_bytes >= 200 and cv <= 0.5 and confidence >= 0.7, false) as is_beacon
      from (select *, interval_std / mean_interval as cv, least(0.70 + 0.29 * (0.6 * (1 - least((interval_std / mean_interval) / 0.5, 1.0)) + 0.4 * least(n_gaps / 20.0, 1.0)), 0.99) as confidence from s)""",
    "claimed_entities": sql("claimed", "select * from claimed"),
    "c2_after_suppression": sql("starts endpoints claimed", """select s.window_us, s.src_ip, s.dst_ip, s.dst_port, s.timestamp_us, s.seq, cast(case when e.flows is not null then floor(e.bytes / n) else 40 end as bigint) as bytes
      from (select *, count(*) over (partition by window_us, src_ip, dst_ip, dst_port) as n from starts) s left join endpoints e using (window_us, src_ip, dst_ip, dst_port)
      where not coalesce(e.packets / e.flows > 60 or (e.established = 0 and e.data_bytes = 0), false)
      and not exists (select 1 from claimed c where c.window_us = s.window_us and ((kind = 'dst' and ip = s.dst_ip) or (kind = 'src' and ip = s.src_ip)))"""),
    "portscan_windows_30_10": _portscan("scan_rows", 30),
    "portscan_windows_10_2": _portscan("scan_rows_10_2", 10),
    "portscan_entropy": sql("scan_rows", f"select src_ip, start_us, {q('abs(log2(sum(c)) - sum(c * log2(c)) / sum(c))')} as dst_port_entropy from (select src_ip, start_us, dst_port, count(*) as c from scan_rows group by 1, 2, 3) group by 1, 2"),
    "portscan_distinct_max": sql("scan_rows", """select src_ip, start_us, max(p) as max_ports_to_single_host, max(h) as max_hosts_on_single_port from (select src_ip, start_us, count(distinct dst_port) as p, 0 as h from scan_rows group by 1, 2, dst_ip
      union all select src_ip, start_us, 0, count(distinct dst_ip) from scan_rows group by 1, 2, dst_port) group by 1, 2"""),
    "portscan_candidates": f"select src_ip, start_us, unique_dst_ports, failed_connections, scan_rate from ({_portscan('scan_rows', 30)}) where unique_dst_ports >= 10",
    "c2_units_tumbling": _units("units_60", 60),
    "c2_units_60_10": _units("units_60_10", 60),
    "c2_units_300_60": _units("units_300_60", 300),
    "c2_ext_features": f"select start_us, orig_h, resp_h, resp_p, proto, iat_madn, dur_mean, dur_cov, pkts_cov, bytes_mean, host_flow_share from ({_units('units_60', 60)})",
    "c2_fanin_fanout": f"select start_us, orig_h, resp_h, resp_p, proto, endpoint_host_fanin, host_endpoint_fanout from ({_units('units_60', 60)})",
    "dga_char_ratios": sql("domains_v", f"""select seq, domain, length(s) as sld_length, length(domain) as full_length, len(string_split(domain, '.')) - 1 as num_dots, len(string_split(domain, '.')) as num_labels, list_max(list_transform(string_split(domain, '.'), lambda x: length(x))) as max_label_length,
      {', '.join(f"{q(f'length(regexp_replace(s, {chr(39)}[^{c}]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})) / greatest(length(s), 1)')} as {n}" for n, c in (('digit_ratio', '0-9'), ('alpha_ratio', r'\p{L}'), ('consonant_ratio', 'bcdfghjklmnpqrstvwxyz'), ('vowel_ratio', 'aeiou'), ('hyphen_ratio', '-')))},
      {q("len(list_distinct(list_filter(string_split(s, ''), lambda x: x <> ''))) / greatest(length(s), 1)")} as unique_char_ratio from (select *, {_LABEL} as s from domains_v)"""),
    "dga_entropy": sql("domains_v", f"""select seq, domain, {q(_entropy(_LABEL))} as entropy, {q(_entropy("case when domain like '%.%' then replace(left(domain, length(domain) - length(split_part(domain, '.', -1)) - 1), '.', '') else domain end"))} as full_entropy from domains_v"""),
    "dga_consonant_run": sql("domains_v", f"select seq, domain, coalesce(list_max(list_transform(regexp_extract_all({_LABEL}, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) as max_consonant_run from domains_v"),
    "dga_bigram_ratio": sql("domains_v", f"""select seq, domain, {q(f"case when length(s) >= 2 then len(list_filter(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), lambda g: list_contains({_BIGRAMS}, g))) / (length(s) - 1) else 0 end")} as common_bigram_ratio from (select *, {_LABEL} as s from domains_v)"""),
    "dga_transitions": sql("domains_v", f"""select seq, domain, {q("coalesce(len(list_filter(range(1, length(s)), lambda i: regexp_matches(substr(s, i, 1), '[0-9]') <> regexp_matches(substr(s, i + 1, 1), '[0-9]'))), 0) / greatest(length(s) - 1, 1)")} as digit_alpha_transitions,
      cast(regexp_matches(s, '^[0-9]') as double) as starts_with_digit, cast(regexp_matches(s, '[0-9]$') as double) as ends_with_digit, cast(split_part(domain, '.', -1) in ('com','net','org','edu','gov','co','io','dev') as double) as popular_tld from (select *, {_LABEL} as s from domains_v)"""),
    "dga_ngram_vocab": sql("domains_v", f"""select ngram, count(*) as n from (select distinct seq, unnest(list_concat(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) as ngram from (select *, {_LABEL} as s from domains_v)) group by 1 order by n desc, ngram limit 200"""),
    "alert_stats_by_class": sql("alerts_v", f"select threat_class, {', '.join(f'''count(*) filter (severity = '{s}') as {s.lower()}''' for s in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))}, count(*) as total, {q('avg(confidence)')} as avg_confidence, count(distinct src_ip) as sources from alerts_v group by 1"),
    "alert_stats_by_severity": sql("alerts_v", "select severity, count(*) as n from alerts_v group by 1"),
    "alert_totals": sql("alerts_v", f"select count(*) as total_alerts, {q(f'count(*) / {(AS_OF_US - START_US) / 60e6}', 2)} as alerts_per_minute, cast({(AS_OF_US - START_US) // 1000000} as bigint) as uptime_seconds from alerts_v"),
    "alert_top_sources": sql("alerts_v", "select src_ip, count(*) as n from alerts_v group by 1 order by n desc, src_ip limit 20"),
    "alert_page": sql("alerts_v", f"select {_ALERT} from alerts_v where severity = 'HIGH' order by ts_us desc, alert_id limit 50 offset 50"),
    "alert_recent": sql("alerts_v", f"select {_ALERT} from alerts_v order by seq desc limit 20"),
    "alert_timeline_10s": sql("alerts_v", f"select (ts_us // 10000000) * 10 as bucket_s, {_PER_CLASS}, count(*) as total from alerts_v where ts_us between {AS_OF_US} - 3600000000 and {AS_OF_US} group by 1"),
    "alert_minute_zero_filled": sql("alerts_v", f"select m as minute, count(seq) as n from range({(AS_OF_US - 900000000) // 60000000}, {AS_OF_US // 60000000} + 1) t(m) left join alerts_v on ts_us // 60000000 = m group by 1"),
    "alert_second_slots": sql("alerts_v", f"select ts_us // 1000000 as second, {_PER_CLASS}, count(*) as total from alerts_v where {_LIVE} group by 1 order by 1 desc limit 34"),
    "alert_search": sql("alerts_v", f"select {_ALERT} from alerts_v where contains(lower(src_ip||' '||dst_ip||' '||src_ip||':'||src_port||'-'||dst_ip||':'||dst_port||' '||threat_class||' '||src_port||' '||dst_port), '113.1') and severity = 'CRITICAL'"),
    "alert_worst": sql("alerts_v", f"select {_ALERT} from alerts_v order by {_RANK} desc, ts_us desc, alert_id limit 10"),
    "alert_status_level": sql("alerts_v", f"select *, case when critical > 0 then 'attack' when high > 0 or medium > 2 then 'elevated' else 'clear' end as level from (select count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium from alerts_v where {_LIVE})"),
    "alert_active_classes": sql("alerts_v", f"select distinct threat_class from alerts_v where {_LIVE}"),
    "source_risk": sql("alerts_v", f"select src_ip, count(*) as n, cast(least(floor(6 * count(*) + 40 * {q('avg(confidence)', 9)} + 0.5), 100) as bigint) as risk from alerts_v group by 1"),
    "alert_describe": sql("alerts_v", f"""select alert_id, case threat_class when 'DDoS' then 'Traffic flood aimed at '||dst_ip||' from '||src_ip||'.' when 'PortScan' then src_ip||' is scanning ports on '||dst_ip||'.' when 'DGA' then src_ip||' is looking up suspicious auto-generated domains.'
      when 'C2_BEACONING' then src_ip||' is beaconing to '||dst_ip||' at regular intervals.' when 'EncryptedMalware' then 'Suspicious encrypted traffic from '||src_ip||' to '||dst_ip||'.' else 'Large upload from '||src_ip||' to '||dst_ip||' — possible data theft.' end as sentence,
      case when s < 5 then 'just now' when s < 60 then s||' sec ago' when s < 3600 then s // 60||' min ago' else strftime(make_timestamp(ts_us), '%H:%M:%S') end as ago from (select *, greatest(({AS_OF_US} - ts_us) // 1000000, 0) as s from alerts_v)"""),
    "severity_bands": sql("alerts_v", """select alert_id, case threat_class when 'PortScan' then case when c >= 0.98 then 'CRITICAL' when c >= 0.90 then 'HIGH' when c >= 0.80 then 'MEDIUM' else 'LOW' end when 'DDoS' then case when c >= 0.97 then 'CRITICAL' when c >= 0.93 then 'HIGH' else 'MEDIUM' end
      when 'DataExfiltration' then case when c >= 0.99 then 'CRITICAL' when c >= 0.95 then 'HIGH' when c >= 0.90 then 'MEDIUM' else 'LOW' end when 'EncryptedMalware' then case when c >= 0.95 then 'CRITICAL' when c >= 0.85 then 'HIGH' when c >= 0.70 then 'MEDIUM' else 'LOW' end
      when 'C2_BEACONING' then case when c >= 0.95 then 'CRITICAL' when c >= 0.85 then 'HIGH' when c >= 0.75 then 'MEDIUM' else 'LOW' end else case when c >= 0.95 then 'CRITICAL' when c >= 0.90 then 'HIGH' when c >= 0.80 then 'MEDIUM' else 'LOW' end end as band from (select alert_id, threat_class, confidence as c from alerts_v)"""),
    "conn_state_histogram": sql("flows_v", "select conn_state, count(*) as n from flows_v group by 1"),
    "latency_percentiles": f"select {q('quantile_cont(value, 0.5)')} as p50, {q('quantile_cont(value, 0.95)')} as p95, {q('quantile_cont(value, 0.99)')} as p99, {q('max(value)')} as max, {q('avg(value)')} as mean from events",
    "pr_curve_best_f1": f"""with s as (select confidence as t, sum(case when severity in ('CRITICAL', 'HIGH') and threat_class <> 'DGA' then 1 else 0 end) as pos, count(*) as n from ({CTE['alerts_v'][1]}) group by 1),
      c as (select t, sum(pos) over (order by t desc) as tp, sum(n) over (order by t desc) as p, sum(pos) over () as total from s)
      select {q('t')} as threshold, f1, {q('tp / p')} as precision from (select *, {q('coalesce(2 * tp / (p + total), 0)')} as f1 from c) order by f1 desc, t limit 1""",
    "radar_activity": sql("alerts_v", "select threat_class, cast(least(4 * count(*) + 18, 100) as bigint) as activity from alerts_v group by 1"),
    "behavioural_score": sql("alerts_v", f"""select alert_id, {q('b')} as behavioural, {q('0.6 * confidence + 0.4 * b')} as fused from (select *, least(0.55 * confidence + 0.45 * least((log10(abs(dst_port) + 10) + log10(abs(100 * confidence) + 10)) / 6, 1.0), 1.0) as b from alerts_v)"""),
}


def _any_suffix(suffixes: tuple[str, ...]) -> str:
    return " or ".join(f"domain like '%{s}'" for s in suffixes)


ORACLE_SQL["dga_safe_domain"] = sql(
    "domains_v",
    f"""select seq, domain, ({_any_suffix(D.LOCAL_SUFFIXES)} or starts_with(domain, '_') or contains(domain, '._tcp.') or contains(domain, '._udp.') or {_any_suffix(D.INFRASTRUCTURE_SUFFIXES)}
      or array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') in ({", ".join(f"'{x}'" for x in D.SAFE_NAMES)})) as is_safe from domains_v""",
)
# The attack view: made apart from the DataFrame code, as a union of its five kinds.
_ATTACKS = """with e as (select event_id as seq, event_id // 500 as b, cast(event_id % 500 as int) as j, event_id // 500 % 2 = 0 as over_limit, 1704067200000000 + event_id // 500 * 10000000 as w, cast(event_id // 500 % 250 as varchar) as n, cast(event_id // 500 % 250 + 1 as varchar) as n1 from events),
  t as (
    select seq, w + j * case when b % 4 = 0 then 200 else 20000 end as timestamp_us, false as back, '10.8.'||(j % 40)||'.7' as cli, '10.9.'||n||'.9' as srv, 20000 + j % case when over_limit then 210 else 100 end as cp, 80 as sp, 60 as packet_len, true as syn, false as ack, false as psh from e where j < 210
    union all select seq, w + j * 10000, false, '10.7.'||n||'.7', '10.9.'||n||'.8', 40000 + j, 20 + j % case when over_limit then 40 else 10 end, 60, true, false, false from e where j between 210 and 249
    union all select seq, w + (j - 250) // 5 * 500000 + j % 5 * 10000, j % 5 = 4, '10.3.3.'||n1, '203.0.113.'||n1, 42000 + (j - 250) // 5, 4444, case when over_limit then 220 else 100 end, false, true, true from e where j between 250 and 309
    union all select seq, w + (j - 310) * 10000, j % 60 = 59, '10.1.1.'||n1, '198.51.100.9', 50000, 8444, case when j % 60 = 59 then 60 when over_limit then 1400 else 400 end, false, true, true from e where j between 310 and 429
    union all select seq, w + case when over_limit then c * 1300000 else c * c * 190000 end + k * 1000, k = 1, '10.2.'||n||'.'||(who + 1), case when who = 1 then '203.0.113.'||n1 else '198.51.100.66' end, 41000 + i // 3, 9001, 90, k < 2, k > 0, k = 2
      from (select *, i // 21 as who, i % 21 // 3 as c, i % 21 % 3 as k from (select *, j - 430 as i from e where j >= 430)))
  select seq, timestamp_us, case when back then srv else cli end as src_ip, case when back then cli else srv end as dst_ip, case when back then sp else cp end as src_port, case when back then cp else sp end as dst_port,
    6 as protocol, packet_len, syn, ack, false as rst, false as fin, psh from t"""
_OVER = {"packets_v": _ATTACKS}
_UNCLAIMED = """select s.window_us, s.src_ip, s.dst_ip, s.dst_port, s.timestamp_us, s.seq, cast(case when e.flows is not null then floor(e.bytes / n) else 40 end as bigint) as bytes
      from (select *, count(*) over (partition by window_us, src_ip, dst_ip, dst_port) as n from starts) s left join endpoints e using (window_us, src_ip, dst_ip, dst_port)
      where not coalesce(e.packets / e.flows > 60 or (e.established = 0 and e.data_bytes = 0), false)
      and not exists (select 1 from claimed c where c.window_us = s.window_us and ((kind = 'dst' and ip = s.dst_ip) or (kind = 'src' and ip = s.src_ip)))"""
ORACLE_SQL |= {
    "attack_floods": sql("floods", f"select window_us, dst_ip, src_ip, scan_shaped, is_flood, {q('confidence')} as confidence, case when is_flood then case when confidence >= 0.97 then 'CRITICAL' when confidence >= 0.93 then 'HIGH' else 'MEDIUM' end end as severity from floods", view=_OVER),
    "attack_sessions": sql("sessions", f"select window_us, src_ip, dst_ip, dst_port, sessions, bytes, fwd_bytes, psh, packets, {q('bytes / sessions')} as bytes_per_session, {q('psh / sessions')} as psh_per_session, is_encrypted_malware from sessions", view=_OVER),
    "attack_uploads": sql("flows", f"""select window_us, flow_key, fwd_bytes, bwd_bytes, {q('up')} as up_down_ratio, confidence, confidence >= 0.98997 as is_exfiltration, case when confidence >= 0.99 then 'CRITICAL' when confidence >= 0.95 then 'HIGH' when confidence >= 0.90 then 'MEDIUM' else 'LOW' end as severity from (
      select *, case when fwd_bytes > 500000 and up > 5 then 0.995 when fwd_bytes > 100000 and up > 10 then 0.992 else 0.0 end::double as confidence from (select *, fwd_bytes / greatest(bwd_bytes, 1) as up from flows where protocol = 6 and total_packets >= 3 and fwd_bytes >= 1000))""", view=_OVER),
    "attack_claims": sql("claimed", "select * from claimed", view=_OVER),
    "attack_unclaimed_starts": sql("starts endpoints claimed", _UNCLAIMED, view=_OVER),
    "attack_beacons": sql("starts endpoints claimed", f"""select src_ip, dst_ip, dst_port, beacon_count, n_gaps, {q('mean_interval')} as mean_interval, {q('cv')} as cv, {q('confidence')} as confidence, total_bytes,
      coalesce(beacon_count >= 5 and span <= 3600 and n_gaps >= 4 and mean_interval >= 1 and total_bytes >= 200 and cv <= 0.5 and confidence >= 0.7, false) as is_beacon
      from (select *, interval_std / mean_interval as cv, least(0.70 + 0.29 * (0.6 * (1 - least((interval_std / mean_interval) / 0.5, 1.0)) + 0.4 * least(n_gaps / 20.0, 1.0)), 0.99) as confidence from paced)""", (
        ("kept", f"select *, sum(bytes) over (partition by src_ip, dst_ip, dst_port) as total, row_number() over (partition by src_ip, dst_ip, dst_port order by timestamp_us desc, seq desc) as rank, timestamp_us / 1e6 as ts from ({_UNCLAIMED})"),
        ("gapped", "select *, ts - lag(ts) over (partition by src_ip, dst_ip, dst_port order by ts, seq) as gap from kept where rank <= 256"),
        ("paced", """select src_ip, dst_ip, dst_port, count(*) as beacon_count, max(ts) - min(ts) as span, count(gap) filter (gap between 1 and 900) as n_gaps, avg(gap) filter (gap between 1 and 900) as mean_interval,
          stddev_pop(gap) filter (gap between 1 and 900) as interval_std, cast(min(total) as bigint) as total_bytes from gapped group by 1, 2, 3"""),
    ), _OVER),
    "dga_safe_names": """select page_id as seq, case page_id % 5 when 0 then 'host'||page_id||'.lan' when 1 then '_svc'||page_id||'._tcp.example.org' when 2 then 'api'||page_id||'.zoom.us' when 3 then 'e'||page_id||'.akamaiedge.net' else 'x'||page_id||'notzoom.us' end as domain,
      page_id % 5 < 4 as is_safe from pages""",
}
# packet by packet: every step of the recursion takes the next packet of each key and its record so far
def _over_us(w: str, flush_us: int | None) -> str:
    """When a record (columns of ``w``) is over if nothing else comes."""
    idle = f"{w}last_us + case when {w}opened and {w}resp = 0 then 3000000 else 30000000 end + 1"
    if not flush_us:
        return idle
    due = f"case when {w}resp = 0 then least({w}last_us + 3000001, greatest({w}first_us + 1000000, {w}last_us + 1)) else {w}last_us + 3000001 end"
    return f"least({idle}, ({due} + {flush_us - 1}) // {flush_us} * {flush_us})"


def _connections(view: dict[str, str] | None = None, flush_us: int | None = None) -> str:
    known = [f", {x} as known_us" if flush_us else "" for x in (f"case when reset or closed then last_us else {_over_us('', flush_us)} end", "timestamp_us")]
    return "with recursive" + sql(
    "packets_v",
    f"""select first_us as ts_us, src_ip, dst_ip, cast(dst_port as varchar) as dst_port, conn_state, floor((last_us - first_us) / 1e6 * 1e6 + 0.5) / 1e6 as duration, cast(orig as double) as orig_pkts, cast(resp as double) as resp_pkts,
      case when conn_state = 'S0' and orig = 1 then 'S' else '-' end as history{known[0]}
      from (select *, case when opened and resp = 0 then case when reset then 'REJ' else 'S0' end when resp > 0 and reset then 'RSTO' when resp > 0 and closed then 'SF' else 'OTH' end as conn_state from final)
      union all select timestamp_us, src_ip, dst_ip, cast(dst_port as varchar), 'SF', 0.0, 1.0, 0.0, '-'{known[1]} from scanners where protocol = 17 and src_port not in (22,25,53,80,110,135,139,143,443,445,993,995,3389,8080,8443)""",
    (
        ("scanners", "select * from packets_v where not (src_ip like '%.255' or src_ip like '%.0' or src_ip like '224.%' or src_ip like '239.%' or src_ip like '127.%' or src_ip like '162.159.%' or src_ip like '104.16.%')"),
        ("both_ways", """select src_ip, dst_ip, dst_port, true as own, timestamp_us, seq, syn, rst, fin,
          not (syn and not ack) and (src_port in (22,25,53,80,110,135,139,143,443,445,993,995,3389,8080,8443) or src_port < 1024) and dst_port > 1024 as reply from scanners where protocol = 6
          union all select dst_ip, src_ip, src_port, false, timestamp_us, seq, syn, rst, fin, false from scanners where protocol = 6"""),
        ("lined", "select *, row_number() over (partition by src_ip, dst_ip, dst_port order by timestamp_us, seq, own desc) as n from both_ways"),
        ("walk", f"""select src_ip, dst_ip, dst_port, cast(0 as bigint) as n, false as open, cast(0 as bigint) as first_us, cast(0 as bigint) as last_us, 0 as orig, 0 as resp, false as opened, false as reset, false as closed, 0 as rec
          from (select distinct src_ip, dst_ip, dst_port from lined)
          union all
          select src_ip, dst_ip, dst_port, n, touched and not (own and (rst or fin)), case when creates then timestamp_us else first_us end, case when touched and own then timestamp_us else last_us end,
            case when creates then 1 when alive and own then orig + 1 else orig end, case when creates then 0 when alive and not own then resp + 1 else resp end,
            case when creates then syn when alive and own then opened or (syn and not reply) else opened end, case when creates then rst when alive and own then reset or rst else reset end,
            case when creates then fin when alive and own then closed or fin else closed end, case when creates then rec + 1 else rec end
          from (select *, alive or creates as touched from (select *, own and not alive and not reply as creates from (
            select r.*, w.first_us, w.last_us, w.orig, w.resp, w.opened, w.reset, w.closed, w.rec, w.open and r.timestamp_us < {_over_us('w.', flush_us)} as alive
            from walk w join lined r on r.src_ip = w.src_ip and r.dst_ip = w.dst_ip and r.dst_port = w.dst_port and r.n = w.n + 1)))"""),
        ("final", "select * from walk where rec > 0 qualify row_number() over (partition by src_ip, dst_ip, dst_port, rec order by n desc) = 1"),
    ),
    view,
    ).removeprefix("with")


ORACLE_SQL["conn_state_from_packets"] = _connections()
ORACLE_SQL["attack_connections"] = _connections(_OVER)
ORACLE_SQL["attack_flushed_records"] = _connections(_OVER, 10_000_000)
ORACLE_SQL["alert_dedup_merge"] = sql("alerts_v", f"select {_ALERT} from alerts_v order by ts_us desc, alert_id limit 5000")
