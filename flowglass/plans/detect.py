"""From events to suppressed alerts: features, rules, guards, evidence."""
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions import ip, text
from ..functions.numbers import log_vector
from ..operators import beacons, connections, history, portable, rates, readable, sessions
from ..operators.bayes import predict_gaussian
from ..operators.throttle import throttle
from ..session import cut, dealt
from ..sources.wire import stage


@dataclass(frozen=True)
class Thresholds:
    """Rule thresholds; the defaults are the long-standing ones."""
    flood_rate: float = 1000.0
    flood_share: float = 0.70
    amplifier_sources: int = 16
    amplifier_mean_bytes: float = 512.0
    slow_connections: int = 50
    slow_min_age_s: float = 30.0
    c2_min_history: int = 8
    c2_min_iat_s: float = 1.0
    c2_max_cv: float = 0.3
    recon_fanout: int = 20
    recon_floor: int = 10
    recon_min_syn: float = 0.1
    exfil_bytes: int = 20_000_000
    slow_c2_events: int = 10
    slow_c2_min_s: float = 8.0
    slow_c2_max_s: float = 1800.0
    slow_c2_max_cv: float = 0.1
    slow_c2_excluded_ports: tuple = (53, 67, 68, 123, 137, 138, 161, 1900, 5353, 5355)
    natural_vowels: float = 0.36
    tunnel_label: int = 50
    tls_min_packets: int = 8
    tls_max_size_cv: float = 0.25
    tls_max_iat_cv: float = 0.25
    tls_max_mean_bytes: float = 600.0
    tls_max_clients: int = 1
    tls_min_population: int = 5
    posterior: float = 0.8
    suppress_ms: int = 30_000
    suppress_slow_ms: int = 3_600_000
    tunnel_candidate: bool = False
    readable_words: tuple = ()
    word_table: object = None  # DataFrame(word); takes the place of readable_words
    name_model: object = None  # operators.portable.Portable; takes the place of the generated-name rule
    name_score: float = 0.5
    indicators: dict = field(default_factory=dict)  # kind -> {fingerprint: note}
    indicator_table: object = None  # DataFrame(kind, fingerprint, note) of any length; takes the place of indicators

    def with_(self, **kw):
        return replace(self, **kw)


# Fixed value: the classifier's inputs, in order.
MODEL_INPUTS = ["packet_rate", "byte_rate", "source_entropy", "syn_fraction", "iat_mean", "iat_cv", "destination_count", "port_count",
                "domain_entropy", "domain_length", "domain_digit_ratio", "bigram_surprise", "txt_record", "encrypted", "size_cv",
                "egress_bytes", "byte_ratio", "reverse_available", "fingerprint_risk", "history_count"]
KINDS = ["ja3", "ja3s", "ja4", "quic"]


def name_features(rows: DataFrame) -> DataFrame:
    """Lexical numbers of the queried name, and of its registrable part for the generated-name rule."""
    named = F.length(F.coalesce("dns_name", F.lit(""))) > 0
    # Staged, so that the name's parts are not substituted into every number made from them.
    r = stage(rows, {"_full": text.clean_name("dns_name"), "_reg": text.registrable_name("dns_name")})
    r = stage(r, {"_lb": text.first_label("_full"), "_rl": text.first_label("_reg")})
    r = r.withColumns(text.guard_features("_lb")).withColumns({"_r" + k: v for k, v in text.guard_features("_rl").items()})
    return r.withColumns({"domain_length": F.length("_full"), "txt_record": (F.col("dns_type").isin(10, 16) & named).cast("int")})


def name_decisions(rows: DataFrame, th: Thresholds) -> DataFrame:
    """dns_name, `_name_score` by the name model and `_readable` by the word table, where they are set: one row per different name of `rows`."""
    n = stage(rows.select("dns_name").filter("dns_name is not null").distinct(), {"_label": text.domain_label("dns_name"), "_own": text.domain_label(text.registrable_name("dns_name"))})
    n = cut(n)  # names alone, read by each judge
    if th.name_model is not None:
        scores = portable.label_scores(n, th.name_model, "_label").select(F.col("label").alias("_label"), F.col("score").alias("_name_score"))
        n = n.join(scores, "_label", "left")
    if th.word_table is not None:
        seen = readable.readable_labels(n.select(F.col("_own").alias("label")).filter("label <> ''"), th.word_table)
        n = n.join(seen.select(F.col("label").alias("_own"), F.col("readable").alias("_readable")), "_own", "left")
    return n.drop("_label", "_own")


def all_features(events: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Every causal feature of every event, one wide row per `seq`.

    Each family reads the few columns it needs, is shuffled by its own key and comes
    back as a narrow table; all of them meet on `seq`, one shuffle per family."""
    old = set(events.columns)
    added = lambda df: df.select("seq", *[c for c in df.columns if c not in old])
    web = connections.orient(events)
    parts = [
        added(history.source_history(events)), added(rates.forward_bytes(events)), added(rates.global_rates(events)), added(rates.target_rates(events)),
        sessions.tls_features(events).drop("ts_us", *sessions.SESSION_KEY),
        beacons.slow_contacts(events).select("seq", "slow_beacon_events", "slow_beacon_mean_s", "slow_beacon_cv"),
        connections.slow_senders(web, min_age_s=th.slow_min_age_s), connections.slow_readers(web, min_age_s=th.slow_min_age_s)]
    r = events.drop("tls_ja4")  # the session's value takes its place
    for part in parts:
        r = r.join(part, "seq", "left")
    if th.indicator_table is not None:
        r = r.join(indicator_matches(r, th.indicator_table), "seq", "left")
    if th.name_model is not None or th.word_table is not None:
        r = r.join(name_decisions(events, th), "dns_name", "left")
    # Lexical work comes after the joins, where rows are spread evenly whatever the input files look like.
    r = history.byte_ratio(name_features(r)).withColumn("udp_destination_concentration", rates.concentration())
    zero = {c: 0 for c in ("tls_session_packets", "tls_fingerprint_clients", "tls_client_population", "slow_beacon_events", "slow_http_connections",
                           "slow_http_open_connections", "slow_read_connections", "slow_read_open_connections", "tls_session_duration_s",
                           "tls_session_mean_bytes", "tls_session_size_cv", "tls_session_small_fraction", "tls_session_iat_mean_s", "tls_session_iat_cv",
                           "slow_beacon_mean_s", "slow_http_mean_age_s", "slow_http_mean_client_rate_bps", "slow_read_mean_age_s", "slow_read_mean_window")}
    return r.fillna({**zero, "slow_beacon_cv": 9.0})


def model_vector() -> list:
    """The classifier's inputs as log1p columns, in `MODEL_INPUTS` order."""
    alias = {"byte_ratio": F.coalesce("observed_byte_ratio", F.lit(0.0)), "reverse_available": F.col("reverse_observed").cast("int"),
             "encrypted": F.col("encrypted").cast("int")}
    v = log_vector(*[alias.get(c, F.col(c)) for c in MODEL_INPUTS])
    return [F.get(v, F.lit(i)) for i in range(len(MODEL_INPUTS))]


def tunnel_pattern() -> Column:
    """Two patterns of repeated, novel, complete questions; null when neither holds."""
    q = F.col
    base = (q("dns_query_visible") == 1) & (q("dns_base_queries_10s") >= 5) & (q("dns_base_unique_ratio_10s") >= 0.8) & (q("dns_base_encoded_queries_10s") >= 4)
    long_label = (q("dns_encoded_max_label_length") >= 40) & (q("dns_encoded_entropy") >= 3.5)
    multi = ((q("dns_label_count") >= 4) & (q("dns_encoded_max_label_length") >= 24) & (q("dns_encoded_total_length") >= 48) & (q("dns_encoded_entropy") >= 3.7))
    return F.when(base & long_label, "repeated_long_encoded_label").when(base & multi, "repeated_multi_label_encoding")


def indicator(th: Thresholds) -> Column:
    """First listed session fingerprint as (kind, fingerprint, note), in the order of `KINDS`.

    A list in `th.indicators` is small and inlined as a map literal per kind; one in `th.indicator_table` was joined before (`_listed`)."""
    if th.indicator_table is not None:
        return F.col("_listed")
    found = []
    for kind in KINDS:
        listed = {k.lower(): v for k, v in th.indicators.get(kind, {}).items()}
        if listed:
            m = F.create_map(*[F.lit(x) for kv in listed.items() for x in kv])
            c = F.col("tls_" + kind)
            note = F.try_element_at(m, F.lower(c))
            found.append(F.when(note.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("fingerprint"), note.alias("note"))))
    none = F.lit(None).cast("struct<kind:string,fingerprint:string,note:string>")
    return F.coalesce(*found, none)


def indicator_matches(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """seq, `_listed`: the first listed session fingerprint as (kind, fingerprint, note), in the order of `KINDS`; rows without one are left out.

    An equality join, so the list may be long; equal entries give the smallest note."""
    own = listed.groupBy("kind", F.lower("fingerprint").alias("_fp")).agg(F.min(F.coalesce("note", F.lit(""))).alias("note"))
    have = [k for k in KINDS if f"tls_{k}" in rows.columns]
    cell = lambda i, k: F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(f"tls_{k}").alias("fingerprint"))
    each = rows.select("seq", F.explode(F.array(*[cell(i, k) for i, k in enumerate(have)])).alias("x")).select("seq", "x.*").filter("fingerprint is not null")
    found = each.withColumn("_fp", F.lower("fingerprint")).join(own, ["kind", "_fp"])
    best = found.groupBy("seq").agg(F.min(F.struct("rank", "kind", "fingerprint", "note")).alias("b"))
    return best.select("seq", F.struct("b.kind", "b.fingerprint", "b.note").alias("_listed"))


def blocks(th: Thresholds) -> dict:
    """Building blocks of the rules that read feature columns only."""
    q = F.col
    tcp, udp = q("protocol") == 6, q("protocol") == 17
    rate = q("syn_target_packet_rate") >= th.flood_rate
    share = lambda c: F.coalesce(q(c) >= th.flood_share, F.lit(False))
    return {
        "syn_only": tcp & rate & share("syn_target_fraction"),
        "syn_ack": tcp & rate & share("syn_target_ack_fraction") & ~share("syn_target_fraction"),
        "udp_flood": udp & (q("udp_target_packet_rate") >= th.flood_rate),
        "slow_http": tcp & (q("slow_http_connections") >= th.slow_connections),
        "slow_read": tcp & (q("slow_read_connections") >= th.slow_connections) & (q("slow_http_connections") < th.slow_connections),
        "slow_beacon": ~q("dst_port").isin(list(th.slow_c2_excluded_ports)) & (q("slow_beacon_events") >= th.slow_c2_events)
        & q("slow_beacon_mean_s").between(th.slow_c2_min_s, th.slow_c2_max_s) & (q("slow_beacon_cv") <= th.slow_c2_max_cv),
        "fast_beacon": (q("history_count") >= th.c2_min_history) & (q("iat_mean") >= th.c2_min_iat_s) & (q("iat_cv") < th.c2_max_cv),
        "fanout": F.greatest("destination_count", "port_count"),
        "tunnel_reason": tunnel_pattern(),
        "generated": generated_name(th),
        "tls_hit": F.when(q("encrypted"), indicator(th)),
        "tls_regular": q("encrypted") & F.coalesce("tls_ja4", "tls_ja3", "tls_quic").isNotNull() & (q("tls_session_packets") >= th.tls_min_packets)
        & (q("tls_session_size_cv") <= th.tls_max_size_cv) & (q("tls_session_iat_cv") <= th.tls_max_iat_cv) & (q("tls_session_mean_bytes") <= th.tls_max_mean_bytes)
        & (q("tls_client_population") >= th.tls_min_population) & (q("tls_fingerprint_clients") <= th.tls_max_clients),
    }


def generated_name(th: Thresholds) -> Column:
    if th.name_model is not None:
        return F.coalesce(F.col("_name_score") >= th.name_score, F.lit(False))
    reg = {k: F.col("_r" + k) for k in ("domain_entropy", "bigram_surprise", "domain_label_length", "domain_vowel_ratio")}
    return text.conservative_rule(reg) & (reg["domain_vowel_ratio"] < th.natural_vowels)


def flags(f: DataFrame, th: Thresholds) -> DataFrame:
    q = F.col
    return f.withColumns(blocks(th)).withColumns({
        "syn_flood": q("syn_only") | q("syn_ack"),
        "tls_path": (q("tls_hit").isNotNull() | q("tls_regular")) & (q("fingerprint_risk") == 0)})


def rule_conditions(th: Thresholds) -> dict:
    q = F.col
    tcp, udp = q("protocol") == 6, q("protocol") == 17
    return {
        "DDOS": F.when(tcp, q("syn_flood") | q("slow_http") | q("slow_read")).when(udp, q("udp_flood")).otherwise(q("packet_rate") >= th.flood_rate),
        "RECONNAISSANCE": q("fanout") >= th.recon_fanout,
        "DNS_TUNNELLING": q("tunnel_reason").isNotNull() if th.tunnel_candidate else (q("domain_label_length") >= th.tunnel_label) & (q("txt_record") == 1),
        "DGA_DOMAINS": q("generated"),
        "BOTNET_C2": q("fast_beacon") | q("slow_beacon"),
        "ENCRYPTED_MALWARE": q("encrypted") & ((q("fingerprint_risk") > 0) | q("tls_path")),
        "DATA_EXFILTRATION": q("source_forward_bytes_60s") > th.exfil_bytes,
    }


def model_allowed(th: Thresholds) -> dict:
    """Where a classifier hit alone may stand."""
    q = F.col
    return {
        "DDOS": F.when(q("protocol") == 6, q("syn_flood")).when(q("protocol") == 17, q("udp_flood")).otherwise(q("packet_rate") >= th.flood_rate),
        "ENCRYPTED_MALWARE": q("transport") != "IP",
        "DNS_TUNNELLING": F.lit(not th.tunnel_candidate),
    }


def guard_conditions(th: Thresholds) -> dict:
    """What a hit must also satisfy; failing rows neither alert nor start a suppression window."""
    q = F.col
    unicast = ~ip.is_multicast("dst_ip") & ~ip.is_broadcast("dst_ip")
    service_reply = q("src_port").between(1, 1023) & ~q("syn")
    browsing = F.coalesce(q("syn_fraction") < th.recon_min_syn, F.lit(False)) & ((q("protocol") == 6) | (q("syn_fraction") > 0))
    resolver = (q("dst_port") == 53) & (q("protocol") == 17) & ip.is_private("dst_ip")
    monitoring = ip.same_local_network("src_ip", "dst_ip") & (((q("protocol") == 17) & (q("dst_port") == 161)) | (q("protocol") == 1))
    named = F.length(F.coalesce("dns_name", F.lit(""))) > 0
    dga = named & q("generated") & ~F.lower(F.coalesce("dns_name", F.lit(""))).startswith("xn--")
    if th.word_table is not None:
        dga = dga & ~F.coalesce("_readable", F.lit(False))
    elif th.readable_words:
        dga = dga & ~text.is_readable(text.domain_label("_reg"), th.readable_words)
    return {
        "RECONNAISSANCE": (q("fanout") >= th.recon_floor) & unicast & ~service_reply & ~q("transport").isin("TLS", "QUIC") & ~browsing,
        "BOTNET_C2": ((q("history_count") >= th.c2_min_history) | q("slow_beacon")) & unicast & ~resolver & ~monitoring,
        "ENCRYPTED_MALWARE": q("encrypted"), "DNS_TUNNELLING": named, "DGA_DOMAINS": dga,
    }


def hits(features: DataFrame, th: Thresholds = Thresholds(), model: dict | None = None) -> DataFrame:
    """One row per (event, threat) that passes rules and guards, before suppression."""
    f = flags(features, th)
    if model:
        vec = [f"_v{i}" for i in range(len(MODEL_INPUTS))]
        f = predict_gaussian(f.withColumns(dict(zip(vec, model_vector()))), model, vec, prefix="model_").drop(*vec)
    else:
        f = f.withColumns({"model_label": F.lit("BENIGN"), "model_posterior": F.lit(1.0)})
    rules, allowed, guards = rule_conditions(th), model_allowed(th), guard_conditions(th)
    found = []
    for threat, rule in rules.items():
        rule = F.coalesce(rule, F.lit(False))
        ml, strength = (F.col("model_label") == threat) & (F.col("model_posterior") >= th.posterior) & allowed.get(threat, F.lit(True)), F.col("model_posterior")
        if threat == "DGA_DOMAINS" and th.name_model is not None:
            rule, ml, strength = F.lit(False), rule, F.col("_name_score")
        ok = (rule | ml) & guards.get(threat, F.lit(True))
        found.append(F.when(ok, F.struct(F.lit(threat).alias("threat_class"), F.when(ml, strength).otherwise(F.lit(0.8)).alias("score"),
                                         F.when(rule & ml, "HYBRID").when(rule, "RULE").otherwise("ML").alias("detector"))))
    f = f.withColumn("_hit", F.explode(F.array_compact(F.array(*found)))).select("*", "_hit.*").drop("_hit")
    slow_only = (F.col("threat_class") == "BOTNET_C2") & F.col("slow_beacon") & ~F.col("fast_beacon")
    f = f.withColumn("slow_only", slow_only)
    t = F.col("threat_class")
    key = (F.when(slow_only, F.concat_ws("|", "src_ip", "dst_ip", F.lit("BOTNET_C2_SLOW")))
           .when(t == "RECONNAISSANCE", F.concat_ws("|", "src_ip", t))
           .when((t == "DDOS") & (F.col("syn_flood") | F.col("udp_flood")), F.concat_ws("|", "dst_ip", t))
           .otherwise(F.concat_ws("|", "src_ip", "dst_ip", t)))
    return f.withColumn("suppress_key", key)


# Evidence fields per class, in narrative order.
EVIDENCE = {
    "DDOS": ["packet_rate", "byte_rate", "source_entropy", "syn_fraction", "source_entropy_partial"],
    "BOTNET_C2": ["iat_mean", "iat_cv", "history_count", "destination_count"],
    "DGA_DOMAINS": ["domain_entropy", "domain_length", "domain_label_length", "bigram_surprise"],
    "DNS_TUNNELLING": ["domain_length", "domain_label_length", "domain_entropy", "txt_record"],
    "ENCRYPTED_MALWARE": ["encrypted", "fingerprint_risk", "size_cv", "iat_cv"],
    "RECONNAISSANCE": ["destination_count", "port_count", "syn_fraction"],
    "DATA_EXFILTRATION": ["egress_bytes", "observed_byte_ratio", "reverse_available"],
    "tls_path": ["encrypted", "tls_ja3", "tls_ja3s", "tls_ja4", "tls_quic", "tls_session_packets", "tls_session_duration_s", "tls_session_mean_bytes",
                 "tls_session_size_cv", "tls_session_small_fraction", "tls_session_iat_mean_s", "tls_session_iat_cv", "tls_fingerprint_clients", "tls_client_population"],
    "slow_http": ["slow_http_connections", "slow_http_open_connections", "slow_http_mean_age_s", "slow_http_mean_client_rate_bps"],
    "slow_read": ["slow_read_connections", "slow_read_open_connections", "slow_read_mean_age_s", "slow_read_mean_window"],
    "slow_only": ["iat_mean", "iat_cv", "history_count", "destination_count", "slow_beacon_events", "slow_beacon_mean_s", "slow_beacon_cv"],
    "candidate": ["dns_query_visible", "dns_label_count", "dns_encoded_max_label_length", "dns_encoded_total_length", "dns_encoded_entropy",
                  "dns_base_queries_10s", "dns_base_unique_ratio_10s", "dns_base_encoded_queries_10s"],
}


def evidence_cases(h: DataFrame, th: Thresholds) -> list:
    """(condition, ordered (name, column) pairs) per alert variant; the first matching case applies."""
    q, lit = F.col, F.lit
    t = q("threat_class")
    plain = lambda k: [(c, q(c)) for c in EVIDENCE[k]]
    window = [("rate_window_seconds", lit(10)), ("rate_window_resolution_ms", lit(1000))]
    spoof = [("source_reserved_count", q("source_reserved_count")), ("source_reserved_fraction", q("source_reserved_fraction")),
             ("source_reserved_basis", F.when(q("source_reserved_count").isNotNull(), "tracked_flood_sources"))]
    syn = [("packet_rate", q("syn_target_packet_rate")), ("global_packet_rate", q("packet_rate")), ("syn_fraction", q("syn_target_fraction")),
           ("syn_fraction_basis", q("syn_target_fraction_basis")), ("source_entropy", q("syn_target_source_entropy")),
           ("source_count_lower_bound", q("syn_target_source_count")), ("source_entropy_partial", q("syn_target_entropy_partial")), ("syn_target", lit("destination_tcp"))]
    udp = [("packet_rate", q("udp_target_packet_rate")), ("byte_rate", q("udp_target_byte_rate")), ("global_packet_rate", q("packet_rate")),
           ("source_entropy", q("udp_target_source_entropy")), ("source_count_lower_bound", q("udp_target_source_count")),
           ("source_entropy_partial", q("udp_target_entropy_partial")), ("destination_concentration", q("udp_destination_concentration")),
           ("mean_packet_bytes", q("udp_packet_size_mean")), ("packet_size_cv", q("udp_packet_size_cv")), ("packet_size_basis", q("udp_packet_size_basis")), ("udp_target", lit("destination_udp"))]
    ddos = t == "DDOS"
    basis = F.when(q("tls_hit").isNotNull(), F.concat(lit("indicator_"), q("tls_hit.kind"))).otherwise("rare_fingerprint_regular_session")
    port_owner = F.when(q("dst_port") < q("src_port"), F.concat_ws(":", "dst_ip", "dst_port")).otherwise(F.concat_ws(":", "src_ip", "src_port"))

    def merged(*parts):
        out = {}
        for p in parts:
            out.update(dict(p))
        return list(out.items())

    return [
        (ddos & q("syn_ack"), merged(plain("DDOS"), window, syn, [("ddos_subtype", lit("syn_ack_flood")), ("syn_ack_fraction", q("syn_target_ack_fraction"))], spoof)),
        (ddos & q("syn_flood"), merged(plain("DDOS"), window, syn, spoof)),
        (ddos & q("udp_flood"), merged(plain("DDOS"), window, udp, spoof)),
        (ddos & q("slow_http"), merged(plain("slow_http"), [("slow_http_target", port_owner), ("ddos_subtype", lit("slow_http"))])),
        (ddos & q("slow_read"), merged(plain("slow_read"), [("slow_read_target", port_owner), ("ddos_subtype", lit("slow_read"))])),
        (ddos, merged(plain("DDOS"), window)),
        (q("slow_only"), merged(plain("slow_only"), [("c2_basis", lit("slow_periodic_contact")), ("slow_beacon_peer", F.concat_ws(":", "dst_ip", "dst_port"))])),
        (t == "BOTNET_C2", plain("BOTNET_C2")),
        ((t == "ENCRYPTED_MALWARE") & q("tls_path"), merged(plain("tls_path"), [("tls_basis", basis), ("tls_indicator_note", q("tls_hit.note"))])),
        (t == "ENCRYPTED_MALWARE", plain("ENCRYPTED_MALWARE")),
        (t == "RECONNAISSANCE", plain("RECONNAISSANCE")),
        (t == "DNS_TUNNELLING", merged(plain("candidate"), [("dns_candidate_pattern", q("tunnel_reason"))]) if th.tunnel_candidate else plain("DNS_TUNNELLING")),
        (t == "DGA_DOMAINS", plain("DGA_DOMAINS")),
        (t == "DATA_EXFILTRATION", merged(plain("DATA_EXFILTRATION"), [
            ("egress_bytes", q("source_forward_bytes_60s")), ("source_forward_byte_rate_10s", q("source_forward_byte_rate_10s")),
            ("source_byte_window_resolution_ms", lit(1000)), ("egress_basis", lit("observed_source_forward_bytes_60s")), ("observed_byte_ratio_status", q("observed_byte_ratio_status"))])),
    ]


# The closing sentences of the narrative.
CLOSING = {
    "amplified": "; consistent with UDP reflection/amplification behavior; passive metadata cannot verify reflection or amplification factor",
    "udp_flood": "; high-rate UDP pattern; passive metadata cannot verify reflection or amplification",
    "forged_sources": "; reserved or martian source addresses among flood sources, a passive indicator of forged sources that cannot prove forgery",
    "slow_http": "; many long-lived low-rate connections held open to one service, consistent with slow-HTTP exhaustion; request contents not inspected",
    "slow_beacon": "; repeated contact with one service at near-constant long intervals (slow periodic beaconing); content not inspected",
    "slow_read": "; many connections held open with a tiny advertised receive window, consistent with a slow-read attack; contents not inspected",
    "exfiltration": "; behavior consistent with possible exfiltration; content and intent unverified",
    "no_reverse": "; reverse traffic unavailable: volume-only suspicion",
    "zero_reverse": "; reverse observed as zero: finite byte ratio undefined",
    "tls_path": "; metadata-only suspicion from handshake fingerprints and session size/timing; payload not decrypted; not proof of malware",
    "lab_fingerprint": "; metadata-only suspicion; lab fingerprint, not proof of malware",
}


def closing_words(th: Thresholds) -> Column:
    """Class-specific closing sentences of the narrative."""
    q, t = F.col, F.col("threat_class")
    ddos = t == "DDOS"
    amplified = (q("udp_target_source_count") >= th.amplifier_sources) & (q("udp_packet_size_mean") >= th.amplifier_mean_bytes)
    say = lambda cond, name: F.when(cond, F.lit(CLOSING[name])).otherwise(F.lit(""))
    held = ddos & ~q("syn_flood")
    return F.concat(
        say(ddos & q("udp_flood") & amplified, "amplified"),
        say(ddos & q("udp_flood") & ~amplified, "udp_flood"),
        say(ddos & q("source_reserved_count").isNotNull(), "forged_sources"),
        say(held & q("slow_http"), "slow_http"),
        say(q("slow_only"), "slow_beacon"),
        say(held & q("slow_read"), "slow_read"),
        say(t == "DATA_EXFILTRATION", "exfiltration"),
        say((t == "DATA_EXFILTRATION") & ~q("reverse_observed"), "no_reverse"),
        say((t == "DATA_EXFILTRATION") & q("reverse_observed") & (q("reverse_bytes") == 0), "zero_reverse"),
        say((t == "ENCRYPTED_MALWARE") & q("tls_path"), "tls_path"),
        say((t == "ENCRYPTED_MALWARE") & ~q("tls_path"), "lab_fingerprint"))


def flood_sources(kept: DataFrame, events: DataFrame) -> DataFrame:
    """Adds martian-source evidence to flood alerts: distinct sources of the destination's window up to the alert.

    Flood alerts of one destination are at least 30 s apart, so each event meets at most one alert."""
    need = kept.filter("threat_class = 'DDOS' and (syn_flood or udp_flood)").select(
        F.col("seq").alias("aseq"), F.col("ts_us").alias("ats"), "dst_ip", "protocol", F.explode(F.sequence(F.col("sec") - rates.SECONDS, F.col("sec"))).alias("sec"))
    seen = events.groupBy("dst_ip", "protocol", "sec", "src_ip").agg(F.min(F.struct("ts_us", "seq")).alias("first"))
    m = seen.join(need, ["dst_ip", "protocol", "sec"]).filter(F.col("first") <= F.struct(F.col("ats").alias("ts_us"), F.col("aseq").alias("seq")))
    per = m.groupBy("aseq", "src_ip").agg(F.lit(1).alias("one")).withColumn("bad", ip.is_martian("src_ip").cast("int"))
    per = per.groupBy("aseq").agg(F.count("*").alias("n"), F.sum("bad").alias("b")).filter("n >= 4 and b > 0")
    per = per.select(F.col("aseq").alias("seq"), F.lit("DDOS").alias("threat_class"), F.col("b").alias("source_reserved_count"), F.round(F.col("b") / F.col("n"), 4).alias("source_reserved_fraction"))
    return kept.join(per, ["seq", "threat_class"], "left")


def alerts(events: DataFrame, th: Thresholds = Thresholds(), model: dict | None = None, features: DataFrame | None = None) -> DataFrame:
    """Suppressed alerts with evidence, narrative and flow identity."""
    h = hits(features if features is not None else all_features(events, th), th, model)
    if features is not None or th.name_model is not None or th.word_table is not None:
        h = h.repartition("seq")  # otherwise the families met on `seq` last
    h = dealt(h.select(*[c for c in h.columns if not c.startswith("_")], F.col("reverse_observed").cast("int").alias("reverse_available")), "seq")
    gap = F.when(F.col("slow_only"), th.suppress_slow_ms * 1000).otherwise(th.suppress_ms * 1000).cast("long")
    passed = throttle(h.select("suppress_key", "ts_us", "seq", "threat_class", gap.alias("gap_us")), ["suppress_key"], "gap_us").filter("kept")
    # By `seq` alone, so that the wide rows stay in their buckets and only what passed is dealt.
    passed = passed.groupBy(F.col("seq").alias("_seq")).agg(F.collect_set("threat_class").alias("_classes"))
    kept = h.join(passed.hint("shuffle_hash"), (h["seq"] == F.col("_seq")) & F.array_contains("_classes", h["threat_class"]), "left_semi")
    kept = cut(flood_sources(kept, events))  # few rows, read three times below
    alerting = events.select("seq", "ts_us", *sessions.FIVE_TUPLE).join(kept.select(*sessions.FIVE_TUPLE).distinct(), sessions.FIVE_TUPLE, "left_semi")
    ids = sessions.flow_identity(alerting).select("seq", F.col("flow_id").alias("own_flow_id"))
    kept = kept.join(ids, "seq")
    types = dict(kept.dtypes)
    cases = evidence_cases(kept, th)
    kind = F.when(F.col("detector") == "RULE", "heuristic strength").otherwise("synthetic-trained model posterior")
    # Every evidence value is materialised once (typed and as text); the cases below only pick among them.
    fields, tag_of, full = {}, {}, []
    for i, (cond, pairs) in enumerate(cases):
        name = [("observed_dns_name", F.col("dns_name"))] if pairs[0][0] == "domain_entropy" else []
        pairs = [*pairs, ("confidence_kind", kind), *name, ("window_partial", F.col("window_partial"))]
        tags = []
        for n, c in pairs:
            tag = tag_of.setdefault((n, str(c)), f"_e{len(fields)}")
            fields.setdefault(tag, (n, c))
            tags.append((n, tag))
        full.append((cond.alias(f"_case{i}"), tags))
    kept = kept.select("*", *[c.alias(tag) for tag, (_, c) in fields.items()], *[c for c, _ in full])
    kinds = dict(kept.dtypes)
    wanted = {tag: [F.col(f"_case{i}") for i, (_, tags) in enumerate(full) if tag in dict((b, a) for a, b in tags)] for tag in fields}
    used = lambda tag: F.coalesce(*[F.when(c, F.lit(True)) for c in wanted[tag]])
    kept = kept.select("*", *[F.when(used(tag), _shown(n, F.col(tag), kinds[tag])).alias(tag + "_t") for tag, (n, _) in fields.items()])
    words, struct = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (_, tags) in reversed(list(enumerate(full))):
        words = F.when(F.col(f"_case{i}"), F.concat_ws("; ", *[tag + "_t" for _, tag in tags])).otherwise(words)
        struct = F.when(F.col(f"_case{i}"), F.to_json(F.struct(*[F.col(tag).alias(n) for n, tag in tags]), {"ignoreNullFields": "false"})).otherwise(struct)
    given = F.coalesce(F.col("flow_id"), F.col("own_flow_id")) if "flow_id" in types else F.col("own_flow_id")
    return kept.select(
        "seq", "ts_us", given.alias("flow_id"), "threat_class", A.confidence3("score").alias("confidence"), A.severity("threat_class").alias("severity"),
        F.concat(words, closing_words(th)).alias("narrative"), "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "detector", struct.alias("evidence"))


def _shown(name: str, c: Column, kind: str) -> Column:
    if kind == "double":
        v = A.number_text(c)
    elif kind == "boolean":
        v = F.when(c, "True").otherwise("False")
    else:
        v = c.cast("string")
    line = F.concat(F.lit(name + "="), v)
    optional = name.startswith("source_reserved") or name == "tls_indicator_note"
    return line if optional else F.coalesce(line, F.lit(name + "=None"))


def spoof_diagnostic(f: DataFrame, rate=1000.0, sources=16, entropy=3.5, singleton=0.75, concentration=0.8) -> DataFrame:
    """Diagnostic only: high UDP rate from many sources seen once, aimed at one destination, with complete counts."""
    q = F.col
    return f.filter((q("udp_target_packet_rate") >= rate) & (q("unique_sources") >= sources) & (q("udp_target_source_entropy") >= entropy)
                    & (q("singleton_fraction") >= singleton) & (q("udp_destination_concentration") >= concentration) & ~q("udp_target_entropy_partial"))
