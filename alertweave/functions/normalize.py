"""Scalar functions on users, addresses, hosts, text and labels, as Column -> Column.

Two dialects of entity names exist: ``strict`` keeps foreign mail names whole and prefixes the kind, ``simple``
cuts every domain and has no prefix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains and host suffixes of the organisation.
ORG_DOMAINS = ("labcorp.local", "labcorp.com", "vsphere.local", "corp.local", "domain.local", "onmicrosoft.com")
ORG_SUFFIXES = (".labcorp.local", ".labcorp.com", ".corp.local", ".domain.local", ".local")
#: Names that identify nothing.
GENERIC_HOSTS_STRICT = ("localhost", "wazuh-server", "wazuh-manager", "", "none", "null", "unknown", "-", "n/a")
GENERIC_HOSTS_SIMPLE = ("", "localhost", "unknown", "-", "wazuh-server", "wazuh", "wazuh-manager")
GENERIC_USERS_SIMPLE = ("", "system", "anonymous", "guest", "-", "root")
ASSET_GENERIC_USERS = ("system", "anonymous", "guest", "root", "administrator", "admin", "none", "null", "unknown", "-", "")

#: What the asset map cuts from hosts, and takes for no host or no address.
ASSET_SUFFIXES = (".labcorp.local", ".corp.local", ".domain.local", ".vsphere.local", ".local")
ASSET_GENERIC_HOSTS = ("", "localhost", "none", "null", "unknown", "-", "n/a")
ASSET_NO_ADDRESS = ("0.0.0.0", "127.0.0.1", "255.255.255.255")
#: Decoder and kinds of entities of an event's source and type.
DECODERS = {"palo_alto": "paloalto-syslog", "vcenter": "vcenter", "office365": "office365", "sentinelone": "sentinelone"}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


_HEX = r"[0-9A-Fa-f]{1,4}"
_GROUPS = rf"{_HEX}(?::{_HEX})*"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often ``f`` names it."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def canonical_ipv6(c: Column) -> Column:
    """Shortest text of valid IPv6 addresses, null otherwise: small letters, the first of the longest runs of zeros as ``::``.

    An IPv4 address at the end counts as two groups; a scope behind ``%`` stays.
    """
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    zeros = lambda k: rf"0(?::0){{{k - 1}}}"

    def plain(text: Column) -> Column:
        tail = F.substring_index(text, ":", -1)
        octets = F.split(tail, r"\.")
        pair = lambda i: F.lower(F.hex(F.get(octets, F.lit(i)).try_cast("int") * 256 + F.get(octets, F.lit(i + 1)).try_cast("int")))
        return F.when(tail.rlike(IPV4), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), pair(0), F.lit(":"), pair(2))).otherwise(text)

    def full(text: Column) -> Column:
        gap = F.contains(text, F.lit("::"))
        left, right = groups(F.substring_index(text, "::", 1)), F.when(gap, groups(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        valid = text.rlike(rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$") & F.when(gap, missing >= 1).otherwise(missing == 0)
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.when(gap, missing).otherwise(0))), right)
        return F.when(valid, F.array_join(F.transform(every, lambda g: F.regexp_replace(g, r"^0+(?=.)", "")), ":"))

    def short(text: Column) -> Column:
        out = text
        for k in range(2, 9):  # the longest run wins
            out = F.when(text.rlike(f"(?:^|:){zeros(k)}(?::|$)"), F.regexp_replace(text, rf"^(.*?)(?:^|(?<=:)|:){zeros(k)}(?::|$)(.*)$", "$1::$2")).otherwise(out)
        return F.regexp_replace(out, ":{3,}", "::")

    named = F.when(F.contains(F.substring_index(c, "%", 1), F.lit(":")) & (~F.contains(c, F.lit("%")) | c.rlike(r"^[^%]+%[^%]+$")), F.lower(F.substring_index(c, "%", 1)))
    scope = F.when(F.contains(c, F.lit("%")), F.regexp_extract(c, r"(%.+)$", 1)).otherwise("")
    return F.concat(bound(bound(bound(named, plain), full), short), scope)


def _bare_address(v: Column, any_case: bool) -> Column:
    s = F.substring_index(F.trim(v), "/", 1)
    mapped = F.lower(s).startswith("::ffff:") if any_case else s.startswith("::ffff:")
    return F.when(mapped, F.substring(s, 8, 64)).otherwise(s)


def norm_user(v: Column, dialect: str = "strict", domains: tuple[str, ...] = ORG_DOMAINS) -> Column:
    """``strict``: user:NAME with organisation domains cut; ``simple``: the first word before @, generic names null."""
    s = F.lower(after_last(blank_to_null(v), "\\"))
    if dialect == "simple":
        s = F.get(F.split(F.trim(F.substring_index(s, "@", 1)), r"\s+"), F.lit(0))
        return F.when(~s.isin(*GENERIC_USERS_SIMPLE), s)
    name, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    ours = domain.isin(*domains)
    for d in domains:
        ours = ours | domain.endswith(f".{d}")
    s = F.when(F.contains(s, F.lit("@")) & ours, name).otherwise(s)
    s = F.regexp_replace(F.trim(F.substring_index(s, "(", 1)), r"[,.;:]+$", "")
    return F.when(s != "", F.concat(F.lit("user:"), s))


def norm_ip(v: Column, dialect: str = "strict") -> Column:
    """Canonical address; ``strict``: ip:ADDRESS without the broadcast address, ``simple``: without multicast ones.

    Loopback and unspecified addresses are null, and so is what is no address.
    """

    def read(s: Column) -> Column:
        drop4 = s.startswith("127.") | (s == "0.0.0.0")
        first = F.substring_index(s, ".", 1).try_cast("int")
        drop4 = drop4 | ((s == "255.255.255.255") if dialect == "strict" else first.between(224, 239))
        drop6 = lambda six: six.isin("::", "::1") | (F.lit(False) if dialect == "strict" else six.startswith("ff"))
        six = bound(F.when(F.contains(s, F.lit(":")), canonical_ipv6(s)), lambda x: F.when(~drop6(x), x))
        return F.when(s.rlike(IPV4), F.when(~drop4, s)).otherwise(six)

    out = bound(_bare_address(v, dialect == "strict"), read)
    return F.concat(F.lit("ip:"), out) if dialect == "strict" else out


def norm_host(v: Column, dialect: str = "strict", suffixes: tuple[str, ...] = ORG_SUFFIXES) -> Column:
    """Short lower-case host name; addresses and generic names are null."""
    s = F.lower(blank_to_null(v))
    if dialect == "simple":
        short = F.when(F.contains(s, F.lit(".")) & (F.substring_index(s, ".", 1) != ""), F.substring_index(s, ".", 1)).otherwise(s)
        return F.when(~s.rlike(IPV4) & ~short.isin(*GENERIC_HOSTS_SIMPLE), short)
    ends = "|".join(x.replace(".", r"\.") for x in sorted(suffixes, key=lambda x: (-len(x), x)))
    s = F.regexp_replace(s, rf"^(.*?)(?:{ends})$", "$1")
    colon = s.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$")
    s = F.when(~s.rlike(IPV4), F.substring_index(s, ".", 1)).otherwise(s)
    return F.when(~s.isin(*GENERIC_HOSTS_STRICT) & ~s.rlike(IPV4) & ~colon, F.concat(F.lit("host:"), s))


def norm_entity(v: Column, kind: Column) -> Column:
    """The strict form by kind: user, ip or host; another kind is null."""
    return F.when(kind == "user", norm_user(v)).when(kind == "ip", norm_ip(v)).when(kind == "host", norm_host(v))


def clean_host(v: Column) -> Column:
    """Dialect of the asset map: no prefix, no organisation suffix."""
    s = F.regexp_replace(F.lower(blank_to_null(v)), r"^host:", "")
    s = F.trim(F.regexp_replace(s, "(?:" + "|".join(x.replace(".", r"\.") for x in ASSET_SUFFIXES) + ")$", ""))
    return F.when(~s.isin(*ASSET_GENERIC_HOSTS), s)


def clean_ip(v: Column) -> Column:
    """Dialect of the asset map: IPv4 only, zeros in front allowed."""
    s = F.trim(_bare_address(F.regexp_replace(blank_to_null(v), r"^ip:", ""), True))
    parts = F.split(s, r"\.")
    ok = s.rlike(r"^\d{1,9}(?:\.\d{1,9}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(ok & ~s.isin(*ASSET_NO_ADDRESS), s)


def clean_user(v: Column) -> Column:
    s = F.regexp_replace(F.lower(blank_to_null(v)), r"^user:", "")
    s = F.regexp_replace(F.trim(F.substring_index(after_last(s, "\\"), "@", 1)), r"[,.;:]+$", "")
    return F.when(~s.isin(*ASSET_GENERIC_USERS), s)


def identity_key(v: Column) -> Column:
    """Short name with dots, hyphens and underscores as one separator."""
    return F.trim(F.regexp_replace(clean_user(v), r"[._-]+", " "))


def ip_after_at(text: Column) -> Column:
    """The first IPv4 address that follows an @."""
    return blank_to_null(F.regexp_extract(text, r"@(\d{1,3}(?:\.\d{1,3}){3})", 1))


def ips_after_at(text: Column) -> Column:
    """All addresses that follow an @, in canonical form and order."""
    found = F.regexp_extract_all(text, F.lit("@([0-9A-Fa-f:.]+)"), 1)
    return F.filter(F.transform(found, lambda x: norm_ip(x)), lambda x: x.isNotNull())


def fingerprint(ts: Column) -> Column:
    """The shape of a timestamp: digits as d."""
    return F.regexp_replace(ts, r"\d", "d")


def incident_base(c: Column) -> Column:
    return F.regexp_replace(c, r"-[0-9a-f]{6,}$", "")


def match_variants(c: Column, aliases: Column | None = None) -> Column:
    """Forms under which a name may appear: lower case, before the @, after the last backslash.

    ``aliases``: a map of names to their pseudonyms; a form that isn't an address adds its pseudonym, bare and as user:.
    """
    s = F.lower(F.trim(c))
    forms = F.filter(F.array_distinct(F.array(s, F.substring_index(s, "@", 1), after_last(s, "\\"))), lambda x: x != "")
    if aliases is None:
        return forms
    named = F.filter(F.transform(F.filter(forms, lambda x: ~x.rlike(IPV4)), lambda x: aliases[x]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(forms, named, F.transform(named, lambda x: F.concat(F.lit("user:"), x))))


def with_prefix_forms(c: Column, *addresses: Column) -> Column:
    """Each entity with and without its kind, and the row's source and destination addresses."""
    more = F.filter(F.array(*addresses), lambda x: x.isNotNull() & (x != "")) if addresses else F.array().cast("array<string>")
    return F.array_distinct(F.concat(c, F.transform(c, lambda x: F.regexp_replace(x, r"^(?:user|ip|host|asset):", "")), more))


def csv_items(c: Column) -> Column:
    """Items of a comma list, trimmed, lower case, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def strip_fence(c: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1"))


TRIAGE = "tipo_incidente string, severidad string, es_probablemente_benigno boolean, entidades_clave array<string>, factores_de_incertidumbre array<string>, acciones_recomendadas array<string>, confianza string, resumen_narrativo string"


def fenced_json(c: Column, schema: str = TRIAGE) -> Column:
    """The answer of a model as a struct: a surrounding code fence is cut, what isn't JSON is null."""
    body = strip_fence(c)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def decoder_of(source: Column) -> Column:
    """The decoder that reads a source's events; an unknown source is its own."""
    known = F.create_map(*(F.lit(x) for kv in DECODERS.items() for x in kv))
    return F.coalesce(known[source], source)


def event_entities(source: Column, entities: Column) -> Column:
    """Entities user:, ip:, host: of an event by the names of its parts (``entities``: map of part to value), sorted.

    A part's kind is told by its name; values are read in the strict dialect.
    """
    kind = lambda k: F.when(k.rlike("(?i)user|account|sender|upn"), "user").when(k.rlike("(?i)ip|addr|c2"), "ip").when(k.rlike("(?i)host|machine|agent|vm"), "host")
    read = F.transform(F.map_entries(entities), lambda e: norm_entity(e["value"], kind(e["key"])))
    return F.when(source.isNotNull(), F.array_sort(F.array_distinct(F.filter(read, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))


def tau_label(seconds: Column) -> Column:
    """A duration in hours, minutes or seconds."""
    n = lambda x: F.regexp_replace(F.format_string("%.1f", x.cast("double")), r"\.0$", "")
    return F.when(seconds >= 3600, F.concat(n(seconds / 3600), F.lit(" h"))).when(seconds >= 60, F.concat(n(seconds / 60), F.lit(" min"))).otherwise(F.concat(n(seconds), F.lit(" s")))


def resolve_template(text: Column, values: dict[str, str]) -> Column:
    """``{{ name }}`` replaced by its value, ``{{ randint(a, b) }}`` by a number from a to b that only the text decides."""
    drawn = F.regexp_extract(text, r"\{\{\s*randint\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s*\}\}", 1).try_cast("bigint"), F.regexp_extract(text, r"\{\{\s*randint\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s*\}\}", 2).try_cast("bigint")
    number = drawn[0] + F.pmod(F.xxhash64(text), F.greatest(F.lit(1), drawn[1] - drawn[0] + 1))
    text = F.when(number.isNotNull(), F.regexp_replace(text, F.lit(r"\{\{\s*randint\([^)]*\)\s*\}\}"), number.cast("string"))).otherwise(text)
    for k, v in values.items():
        text = F.regexp_replace(text, rf"\{{\{{\s*{k}\s*\}}\}}", v)
    return text
