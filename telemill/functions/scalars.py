"""Column builders: clock, identifiers, formats, parsers of log texts, and statistics over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR

# Names of file flags by bit, of TCP states by number, and ports worth a flag.
FILE_FLAGS = {
    0x1: "must_scan_subdirs", 0x2: "user_dropped", 0x4: "kernel_dropped", 0x8: "ids_wrapped", 0x10: "history_done", 0x20: "root_changed", 0x40: "mount", 0x80: "unmount",
    0x100: "created", 0x200: "removed", 0x400: "inode_meta_mod", 0x800: "renamed", 0x1000: "modified", 0x2000: "finder_info_mod", 0x4000: "change_owner", 0x8000: "xattr_mod",
    0x10000: "is_file", 0x20000: "is_dir", 0x40000: "is_symlink", 0x80000: "own_event", 0x100000: "is_hardlink", 0x200000: "is_last_hardlink", 0x400000: "cloned",
}
TCP_STATES = ("CLOSED", "LISTEN", "SYN_SENT", "SYN_RCVD", "ESTABLISHED", "CLOSE_WAIT", "FIN_WAIT_1", "CLOSING", "LAST_ACK", "FIN_WAIT_2", "TIME_WAIT")
SENSITIVE_PORTS = {22: "ssh", 23: "telnet", 3389: "rdp", 5900: "vnc", 4444: "common reverse-shell port"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unix_ns(mono, anchor) -> Column:
    """Absolute time: the anchor plus the monotonic clock, or the latter alone where there is no anchor."""
    return F.when(_c(anchor) == 0, _c(mono)).otherwise(_c(anchor) + _c(mono))


def past(a, b) -> Column:
    """a - b, at least 0."""
    return F.greatest(_c(a) - _c(b), F.lit(0))


def held(start: int, n, unit: int) -> Column:
    """start + n * unit as a long; beyond a long's ends (as ns: the years 1677 and 2262) the end itself."""
    whole = F.lit(start).cast("decimal(20,0)") + _c(n).cast("decimal(19,0)") * F.lit(unit).cast("decimal(15,0)")
    ends = [F.lit(x).cast("decimal(20,0)") for x in (-(1 << 63), (1 << 63) - 1)]
    return F.when(_c(n).isNotNull(), F.least(F.greatest(whole, ends[0]), ends[1]).cast("long"))


def event_hour(ns) -> Column:
    return F.expr(f"({ns} div {HOUR}) % 24") if isinstance(ns, str) else F.floor(ns / F.lit(HOUR)) % 24


def process_key(pid, start) -> Column:
    return F.concat_ws(":", _c(pid).cast("string"), _c(start).cast("string"))


def socket_key(proto, local, foreign) -> Column:
    return F.concat_ws("|", _c(proto), _c(local), _c(foreign))


def domain_id(qname, masked, name_hash) -> Column:
    """A name without one trailing dot; of masked or missing ones the hash; else null."""
    name, h = _c(qname), _c(name_hash)
    plain = (F.length(name) > 0) & ~F.coalesce(_c(masked), F.lit(False))
    return F.when(plain, F.regexp_replace(name, r"\.$", "")).when(F.length(h) > 0, F.concat(F.lit("hash:"), h))


def host_port(addr) -> tuple[Column, Column]:
    """Split at the last dot; without one, the port is '?'."""
    a = _c(addr)
    dotted = F.instr(a, ".") > 0
    return F.when(dotted, F.regexp_extract(a, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(a), F.when(dotted, F.substring_index(a, ".", -1)).otherwise("?")


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_IPV6 = "|".join([rf"({_GROUP}:){{7}}{_GROUP}", *[rf"({_GROUP}:){{1,{7 - k}}}(:{_GROUP}){{1,{k}}}" for k in range(1, 7)], rf":(:{_GROUP}){{1,7}}", rf"({_GROUP}:){{1,7}}:", "::", rf"::([fF]{{4}}:)?{_IPV4}"])


def is_address(host) -> Column:
    """Whether a host is a well-formed IPv4 or IPv6 address."""
    return _c(host).rlike(rf"^({_IPV4}|{_IPV6})$")


def foreign_port(addr) -> Column:
    """The port behind the last dot of an address, if what stands before is an IP address; else null."""
    host, port = host_port(addr)
    number = F.when(port.rlike(r"^\+?[0-9]{1,6}$"), port.cast("int"))
    return F.when(is_address(host) & (number <= 65535), number)


def port_label(port) -> Column:
    out = F.lit(None).cast("string")
    for p, name in SENSITIVE_PORTS.items():
        out = F.when(_c(port) == p, F.lit(name)).otherwise(out)
    return out


def directory_bucket(path) -> Column:
    """The first four components of a path."""
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(_c(path), "/"), lambda c: c != ""), 1, 4), "/"))


def format_address(host, port) -> Column:
    """Host and port joined by a dot, zero ones being '*'."""
    h, p = _c(host), _c(port)
    star = h.isNull() | h.isin("0.0.0.0", "::", "")
    return F.concat_ws(".", F.when(star, "*").otherwise(h), F.when(p == 0, "*").otherwise(p.cast("string")))


def tcp_state(number, proto=None) -> Column:
    """The state's name; null out of range or for other protocols than TCP."""
    n = _c(number)
    name = F.when((n >= 0) & (n < len(TCP_STATES)), F.get(F.array(*[F.lit(s) for s in TCP_STATES]), n))
    return name if proto is None else F.when(_c(proto).startswith("tcp"), name)


def file_flags(mask) -> Column:
    """Names of the set bits, lowest first."""
    known = F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), F.lit(n).alias("name")) for b, n in FILE_FLAGS.items()])
    return F.transform(F.filter(known, lambda x: x.bit.bitwiseAND(_c(mask).cast("long")) != 0), lambda x: x["name"])


def class_bytes(counters) -> Column:
    """The sum of counters, null if any is missing or the list is."""
    c = _c(counters)
    return F.when(F.forall(c, lambda x: x.isNotNull()), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))


def fmt_duration(secs) -> Column:
    """One or two largest units, a zero second one being left out: 45s, 2m5s, 1h, 1d1h."""
    s = _c(secs).cast("long")

    def two(big: int, small: int, a: str, b: str) -> Column:
        first, second = F.floor(s / big), F.floor((s % big) / small)
        return F.concat(first.cast("string"), F.lit(a), F.when(second == 0, "").otherwise(F.concat(second.cast("string"), F.lit(b))))

    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(60, 1, "m", "s")).when(s < 86400, two(3600, 60, "h", "m")).otherwise(two(86400, 3600, "d", "h"))


def fmt_unix_ns(ns, now_ns) -> Column:
    """Unix seconds, with the age unless the time is to come."""
    n, now = _c(ns), _c(now_ns)
    secs = F.floor(n / SECOND)
    age = F.floor(now / SECOND) - secs
    text = F.concat(F.lit("unix "), secs.cast("string"))
    return F.when(age < 0, text).otherwise(F.concat(text, F.lit(" ("), fmt_duration(age), F.lit(" ago)")))


def shortened(payload, most: int = 120) -> Column:
    p = _c(payload)
    return F.when(F.length(p) > most, F.concat(F.substring(p, 1, most), F.lit("…"))).otherwise(p)


def between(text, start: str, end: str) -> Column:
    """What stands between two marks, null without them."""
    t = _c(text)
    rest = F.when(F.instr(t, start) > 0, F.expr(f"substring({text if isinstance(text, str) else 'value'}, instr({text if isinstance(text, str) else 'value'}, '{start}') + {len(start)})"))
    return F.when(F.instr(rest, end) > 0, F.substring_index(rest, end, 1))


def dns_fields(message: str = "message") -> dict[str, Column]:
    """Columns of a resolver's query-start message (a column's name); pid null where the message is another one."""
    qname, client = between(message, "qname: ", ", qtype:"), between(message, "client pid: ", ",")
    return {
        "qname": qname, "qtype": between(message, "qtype: ", ","), "interface_index": between(message, "interface index: ", ",").try_cast("int"), "pid": F.substring_index(client, " ", 1).try_cast("long"),
        "client_process_name": F.regexp_replace(F.trim(F.when(F.instr(client, " ") > 0, F.regexp_extract(client, r"(?s)^\S* (.*)$", 1))), r"^\(+|\)+$", ""),
        "name_hash": F.when(F.instr(F.col(message), "name hash: ") > 0, F.trim(F.substring_index(F.col(message), "name hash: ", -1))).otherwise(""), "masked": qname.startswith("<mask.hash"),
    }


def ewma(values, alpha: float = 0.3) -> Column:
    """mean and var of an array in order, exponentially weighted; the first value primes the mean."""
    v = _c(values)
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0).alias("n"))

    def step(s, x):
        d = x - s.mean
        return F.struct(F.when(s.n == 0, x).otherwise(s.mean + alpha * d).alias("mean"), F.when(s.n == 0, F.lit(0.0)).otherwise((1 - alpha) * (s["var"] + alpha * d * d)).alias("var"), (s.n + 1).alias("n"))

    return F.aggregate(v, start, step, lambda s: F.struct(s.mean.alias("mean"), s["var"].alias("var")))


def z_score(x, mean, var) -> Column:
    return (_c(x) - _c(mean)) / F.greatest(F.sqrt(_c(var)), F.lit(1.0))


def nearest_rank(value: str, p: float) -> Column:
    """The nearest-rank percentile as an aggregate, 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0.0))


def dot_escape(text) -> Column:
    return F.replace(F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_slug(prefix: str, text) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(_c(text), r"[^A-Za-z0-9._\-]", "_"))


def uid_color(uid) -> Column:
    u = _c(uid)
    return F.when(u.isNull(), "#f5f5f5").when(u == 0, "#ffd0d0").when(u.between(501, 600), "#d0e6ff").otherwise("#e8e8e8")
