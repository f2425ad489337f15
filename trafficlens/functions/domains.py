"""Character statistics of host names, as built-in expressions.

The label under study is the first one of the lower-cased name (so "www.x.com" is "www").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bigrams that make a label pronounceable.
COMMON_BIGRAMS = (
    "th", "he", "in", "en", "nt", "re", "er", "an", "ti", "es",
    "on", "at", "se", "nd", "or", "ar", "al", "te", "co", "de",
    "to", "ra", "et", "ed", "it", "sa", "em", "ro", "st", "le",
    "ou", "ng", "ne", "io", "ec", "is", "la", "ea", "ic", "el",
    "oo", "ll", "ma", "go", "ch", "sh", "li", "ve", "ge", "ck",
)
# Popular top-level domains.
POPULAR_TLDS = ("com", "net", "org", "edu", "gov", "co", "io", "dev")
# Suffixes of local names.
LOCAL_SUFFIXES = (
    ".local", ".localhost", ".internal", ".lan", ".home", ".intranet", ".corp", ".arpa", ".test", ".invalid", ".example", ".localdomain",
)
# Suffixes of infrastructure whose names look random.
INFRASTRUCTURE_SUFFIXES = (
    ".akamaiedge.net", ".akamai.net", ".akamaihd.net", ".cloudfront.net", ".amazonaws.com", ".azure.com",
    ".googleapis.com", ".gstatic.com", ".googleusercontent.com", ".googlevideo.com", ".google.com", ".microsoft.com",
    ".windows.net", ".windowsupdate.com", ".office365.com", ".office.com", ".live.com", ".msedge.net",
    ".fbcdn.net", ".facebook.com", ".instagram.com", ".apple.com", ".icloud.com", ".cdn-apple.com",
    ".digicert.com", ".verisign.com", ".letsencrypt.org", ".github.com", ".github.io", ".githubusercontent.com",
    ".stackoverflow.com", ".cloudflare.com", ".fastly.net", ".cdn77.org", ".edgecastcdn.net", ".cedexis.com",
    ".openai.com", ".openrouter.ai", ".anthropic.com", ".huggingface.co", ".replicate.com", ".together.ai",
    ".spotify.com", ".discord.com", ".discord.gg", ".twitch.tv", ".netflix.com", ".whatsapp.com",
    ".telegram.org", ".signal.org",
)
# Registrable names that are safe with any subdomain or none.
SAFE_NAMES = (
    "openrouter.ai", "openai.com", "anthropic.com", "together.ai", "huggingface.co", "replicate.com", "spotify.com", "discord.com",
    "netflix.com", "twitch.tv", "whatsapp.com", "telegram.org", "signal.org", "zoom.us", "slack.com", "notion.so",
)


def _name(domain: Column) -> Column:
    return F.lower(domain)


def label(domain: Column) -> Column:
    return F.substring_index(_name(domain), ".", 1)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _share(n: Column, s: Column) -> Column:
    return n / F.greatest(F.length(s), F.lit(1))


def entropy(s: Column) -> Column:
    """Shannon entropy (bits) of a string's characters; 0 for an empty one."""
    chars, n = _chars(s), F.length(s)
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def ratios(domain: Column) -> dict[str, Column]:
    s, name = label(domain), _name(domain)
    parts = F.split(name, r"\.", -1)
    count = lambda p: F.regexp_count(s, F.lit(p))
    return {
        "sld_length": F.length(s).cast("long"),
        "full_length": F.length(domain).cast("long"),
        "num_dots": F.size(parts).cast("long") - 1,
        "num_labels": F.size(parts).cast("long"),
        "max_label_length": F.array_max(F.transform(parts, F.length)).cast("long"),
        "digit_ratio": _share(count("[0-9]"), s),
        "alpha_ratio": _share(count(r"\p{L}"), s),
        "consonant_ratio": _share(count("[bcdfghjklmnpqrstvwxyz]"), s),
        "vowel_ratio": _share(count("[aeiou]"), s),
        "hyphen_ratio": _share(count("-"), s),
        "unique_char_ratio": _share(F.size(F.array_distinct(_chars(s))), s),
    }


def entropies(domain: Column) -> dict[str, Column]:
    """Entropy of the first label, and of the name without its last label and dots."""
    name = _name(domain)
    parts = F.split(name, r"\.", -1)
    body = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "")).otherwise(name)
    return {"entropy": entropy(label(domain)), "full_entropy": entropy(body)}


def longest_consonant_run(domain: Column) -> Column:
    runs = F.regexp_extract_all(label(domain), F.lit("([bcdfghjklmnpqrstvwxyz]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def bigrams(s: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(empty)


def common_bigram_ratio(domain: Column) -> Column:
    grams = bigrams(label(domain))
    return F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: g.isin(*COMMON_BIGRAMS))) / F.size(grams)).otherwise(0.0)


def digit_transitions(domain: Column) -> Column:
    """Share of neighbouring characters of which one is a digit and one is not."""
    grams = bigrams(label(domain))
    return F.size(F.filter(grams, lambda g: g.rlike("^([0-9][^0-9]|[^0-9][0-9])$"))) / F.greatest(F.size(grams), F.lit(1))


def ends(domain: Column) -> dict[str, Column]:
    s = label(domain)
    return {
        "starts_with_digit": s.rlike("^[0-9]").cast("double"),
        "ends_with_digit": s.rlike("[0-9]$").cast("double"),
        "popular_tld": F.substring_index(_name(domain), ".", -1).isin(*POPULAR_TLDS).cast("double"),
    }


def statistics(domain: Column) -> dict[str, Column]:
    """All 19 statistics of a host name."""
    return {
        **ratios(domain),
        **entropies(domain),
        "max_consonant_run": longest_consonant_run(domain),
        "common_bigram_ratio": common_bigram_ratio(domain),
        "digit_alpha_transitions": digit_transitions(domain),
        **ends(domain),
    }


def _ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, suffixes)), lambda x: F.endswith(name, x))


def is_safe(domain: Column) -> Column:
    """Local, service-discovery, infrastructure and known names are not scored."""
    name = _name(domain)
    service = name.startswith("_") | name.contains("._tcp.") | name.contains("._udp.")
    return _ends_with_any(name, LOCAL_SUFFIXES) | service | _ends_with_any(name, INFRASTRUCTURE_SUFFIXES) | F.substring_index(name, ".", -2).isin(*SAFE_NAMES)


# What a live capture takes for local lookups.
LIVE_SUFFIXES = (".local", ".localhost", ".internal", ".lan", ".home", ".intranet", ".corp", ".arpa")
LIVE_SERVICES = (
    "_tcp.", "_udp.", "_http.", "_https.", "_spotify", "_companion", "_airplay", "_raop", "_smb.", "_afpovertcp.", "_ipp.", "_printer.", "_pdl-datastream.", "_sleep-proxy.", "_homekit.", "_hap.",
    "_matter.", "_googlecast.", "_chromecast.",
)


def is_local_lookup(domain: Column) -> Column:
    """Local names and service discovery, which a live capture never scores."""
    name = F.lower(domain)
    service = F.exists(F.array(*map(F.lit, LIVE_SERVICES)), lambda x: F.contains(name, x))
    return _ends_with_any(name, LIVE_SUFFIXES) | service | name.startswith("_")


def character_ngrams(s: Column, least: int = 2, most: int = 3) -> Column:
    """All character n-grams of a string."""
    empty = F.array().cast("array<string>")

    def of(n: int) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(empty)

    return F.concat(*map(of, range(least, most + 1)))
