"""Column functions that clean filed values; each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of percentage ranges, upper case without white space, and their midpoints.
PERCENT_RANGES = {"0": 0.0, "NONE": 0.0, "1-10%": 5.5, "UPTO10%": 5.0, "11-25%": 18.0, "UPTO25%": 12.5, "26-50%": 38.0, "UPTO50%": 25.0, "51-75%": 63.0, "UPTO75%": 37.5, "76-99%": 87.5, "MORETHAN75%": 87.5, "100%": 100.0}
# Legal forms at the end of a provider's name, as patterns.
PROVIDER_SUFFIXES = ["LLP", "LLC", r"L\.L\.P\.", r"L\.L\.C\.", r"INC\.?", r"P\.C\.", r"LTD\.?"]
# Words that don't tell providers apart.
ENTITY_WORDS = "LLP LLC INC PC PLLC LTD LP NA CO CORP COMPANY LIMITED AND".split()
# Legal forms left out in exact comparisons of names, and in search, as patterns.
NAME_FORMS = ["l ?l ?c", "l ?p", "l ?l ?p", "inc", "corp", "corporation", "co", "company", "ltd", "limited", "pllc", "pc", "the"]
SEARCH_FORMS = ["inc", "llc", "l ?l ?c", "lp", "l ?p", "llp", "ltd", "corp", "corporation", "co", "company", "the"]
# Domains that many firms share, and brands with a domain in many countries.
PLATFORMS = (
    "linkedin.com facebook.com fb.com fb.me instagram.com instragram.com twitter.com x.com t.co threads.net threads.com tiktok.com pinterest.com bsky.app bsky.social warpcast.com nextdoor.com alignable.com quora.com "
    "tumblr.com flickr.com stocktwits.com angel.co wellfound.com crunchbase.com glassdoor.com indeed.com youtube.com youtu.be vimeo.com wistia.com twitch.tv apple.com apple.co spotify.com spoti.fi soundcloud.com podbean.com "
    "libsyn.com buzzsprout.com anchor.fm player.fm podcastindex.org podcastaddict.com iheart.com pandora.com blubrry.net blubrry.com stitcher.com castbox.fm audible.com amazon.com medium.com substack.com wordpress.com "
    "blogspot.com blogger.com wixsite.com weebly.com godaddysites.com squarespace.com notion.site slideshare.net seekingalpha.com qq.com weixin.qq.com weibo.com douyin.com line.me naver.com naver.jp kakao.com t.me "
    "telegram.org whatsapp.com wa.me discord.gg discord.com linktr.ee bio.link google.com g.page goo.gl yelp.com bing.com bit.ly feeonlynetwork.com napfa.org wealthtender.com xyplanningnetwork.com smartasset.com "
    "wiseradvisor.com brokercheck.finra.org finra.org sec.gov zoominfo.com bloomberg.com calendly.com"
).split()
BRANDS = "linkedin facebook instagram twitter youtube tiktok pinterest yelp amazon google apple spotify medium reddit vimeo naver glassdoor indeed bloomberg".split()
SECOND_LEVEL = "co com org net gov ac ne or".split()


def to_number(c: Column) -> Column:
    """A filed number: dollar signs, commas and white space go; blank, a dash or anything else that isn't a number is null."""
    t = F.regexp_replace(c, "[$,\\s]", "")
    return F.when(F.rlike(t, F.lit("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$")), t.cast("double"))


def to_bool(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("Y", "YES", "TRUE", "1"), True).when(t.isin("N", "NO", "FALSE", "0", ""), False)


def is_true_word(c: Column) -> Column:
    """Only the word true counts; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def is_y(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)) == "Y", F.lit(False))


def is_yes(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin("Y", "YES", "TRUE"), F.lit(False))


def percent_midpoint(c: Column) -> Column:
    """The midpoint of a percentage range, or a plain number."""
    label = F.upper(F.regexp_replace(c, "\\s+", ""))
    out = to_number(F.regexp_replace(c, "%", ""))
    for name, mid in PERCENT_RANGES.items():
        out = F.when(label == name, F.lit(mid)).otherwise(out)
    return out


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def display_name(business: Column, legal: Column) -> Column:
    """The business name, or the legal name where that is null or blank."""
    return F.coalesce(blank_to_null(business), legal)


def filed_date(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_date(c, f) for f in formats or ("dd-MMM-yyyy", "MM/dd/yyyy", "yyyy-MM-dd")])


def partial_iso(c: Column) -> Column:
    """Dates that may lack day or month, as ISO prefixes: 2024, 2024-05, 2024-05-17; else null."""
    us = F.regexp_extract(c, "^(\\d{1,2})/(\\d{1,2})/(\\d{4})", 0)
    month = F.regexp_extract(c, "^(\\d{1,2})/(\\d{4})$", 0)
    full = F.concat_ws("-", F.regexp_extract(c, "/(\\d{4})", 1), F.lpad(F.regexp_extract(c, "^(\\d{1,2})", 1), 2, "0"), F.lpad(F.regexp_extract(c, "^\\d{1,2}/(\\d{1,2})/", 1), 2, "0"))
    my = F.concat_ws("-", F.regexp_extract(c, "/(\\d{4})$", 1), F.lpad(F.regexp_extract(c, "^(\\d{1,2})", 1), 2, "0"))
    iso = F.regexp_extract(c, "^\\d{4}(-\\d{2}(-\\d{2})?)?$", 0)
    return F.when(us != "", full).when(month != "", my).when(iso != "", iso)


def suffix_stripped(c: Column) -> Column:
    """Upper case, legal forms at the end taken off again and again; the plain name if nothing is left."""
    t = F.upper(F.trim(c))
    out = F.trim(F.regexp_replace(t, f"([,.]?\\s*({'|'.join(PROVIDER_SUFFIXES)}))+$", ""))
    return F.when(out == "", t).otherwise(out)


def provider_key(c: Column) -> Column:
    """What spellings of one provider share: letters and digits without legal forms and spaces, loose initials joined; the plain name if nothing is left."""
    t = F.trim(F.regexp_replace(suffix_stripped(c), "[^A-Z0-9]+", " "))
    t = F.regexp_replace(t, "(?<=\\b[A-Z]) (?=[A-Z]\\b)", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\b(" + "|".join(ENTITY_WORDS) + ")\\b", ""), " +", "")
    return F.when(t == "", F.upper(F.trim(c))).otherwise(t)


def normalized_name(c: Column) -> Column:
    """For exact matches: lower-case letters and digits, without legal forms; null is empty."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "\\b(" + "|".join(NAME_FORMS) + ")\\b", " "), "\\s+", " "))


def gentle_name(c: Column) -> Column:
    """As normalized_name, but legal forms stay."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def search_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "))


def search_stripped(c: Column) -> Column:
    """search_text without legal forms, if anything is left."""
    t = search_text(c)
    out = F.trim(F.regexp_replace(F.regexp_replace(t, "\\b(" + "|".join(SEARCH_FORMS) + ")\\b", " "), "\\s+", " "))
    return F.when(out == "", t).otherwise(out)


def host_of(url: Column) -> Column:
    """The host, lower case, without www; null for what has none. Points and commas at the end of a filed address are no part of it."""
    full = F.regexp_replace(F.regexp_replace(F.trim(url), "[.,;:)]+$", ""), "^(?!.*://)", "http://")
    host = F.regexp_extract(F.lower(full), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\\.)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_extract(host, "^([a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+)$", 1), F.lit(""))


def registrable(host: Column) -> Column:
    """The last two labels of a host, or three where the last is a country's and the one before a general one."""
    return F.regexp_extract(host, f"([^.]+\\.(?:{'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}|[^.]+\\.[^.]+|[^.]+)$", 1)


def is_platform(host: Column) -> Column:
    """Whether a host belongs to a platform: a listed domain or one below it, or a brand under any country."""
    own = registrable(host)
    below = F.rlike(host, F.lit("\\.(" + "|".join(p.replace(".", "\\.") for p in PLATFORMS if p.count(".") > 1) + ")$"))
    return F.coalesce(host.isin(PLATFORMS) | own.isin(PLATFORMS) | F.substring_index(own, ".", 1).isin(BRANDS) | below, F.lit(False))


def check_class(status: Column, asked: Column, got: Column) -> Column:
    """What a URL check found, by status and by whether it ended on another domain."""
    moved = registrable(host_of(asked)) != registrable(host_of(got))
    return (
        F.when(status.isNull(), "unreachable").when(status.isin(401, 403, 429), "blocked_by_site").when(status.isin(404, 410), "not_found").when(status >= 500, "server_error").when(status >= 400, "http_error")
        .when(F.coalesce(moved, F.lit(False)), "cross_domain_redirect").otherwise("ok")
    )


def clean_text(c: Column, most: int = 160) -> Column:
    """One space for white space, N/A and blank are null; cut at a word's end with an ellipsis."""
    t = F.trim(F.regexp_replace(c, "\\s+", " "))
    t = F.when(~F.upper(t).isin("", "N/A", "NA", "NONE"), t)
    cut = F.regexp_replace(F.substring(t, 1, most), "\\s+\\S*$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("…")))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def cased_name(c: Column) -> Column:
    """Each run of letters with a capital first: O'Brien-Smith."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def band(c: Column, cuts: list[float], labels: list) -> Column:
    """The label of the band that a value falls in: below the first cut, from it to below the second, and so on; null counts as 0."""
    v = F.coalesce(c, F.lit(0.0))
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        out = F.when(v < cut, F.lit(label)).otherwise(out)
    return out


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d))


def compact_usd(c: Column) -> Column:
    """$1.2B, $340M, $12K: one decimal below ten. What rounds to zero from below keeps its sign."""
    out = F.lit(None).cast("string")
    for size, sign in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        v = c / size
        text = F.when(v < 10, F.format_string("%.1f", F.bround(v, 1))).otherwise(F.format_string("%.0f", F.bround(v, 0)))
        out = F.when(c >= size, F.concat(F.lit("$"), text, F.lit(sign))).otherwise(out)
    sign = F.when(F.startswith(F.format_string("%.0f", c), F.lit("-")), "-").otherwise("")
    return F.coalesce(out, F.when(c.isNotNull(), F.concat(F.lit("$"), sign, F.format_string("%.0f", F.abs(F.bround(c, 0))))))


def ordinal(c: Column) -> Column:
    two, one = F.abs(c) % 100, F.abs(c) % 10
    end = F.when(two.between(11, 13), "th").when(one == 1, "st").when(one == 2, "nd").when(one == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), end)


def annual_rate(multiple: Column, years: float) -> Column:
    return F.when(multiple > 0, F.pow(multiple, F.lit(1.0 / years)) - 1)


def largest_label(pairs: list[tuple[str, Column]]) -> Column:
    """The label of the largest value, the first of equal ones; null where all are null or nothing is above zero."""
    most = F.greatest(*[F.coalesce(c, F.lit(0.0)) for _, c in pairs]) if len(pairs) > 1 else F.coalesce(pairs[0][1], F.lit(0.0))
    out = F.lit(None).cast("string")
    for label, c in reversed(pairs):
        out = F.when(F.coalesce(c, F.lit(0.0)) == most, F.lit(label)).otherwise(out)
    return F.when(most > 0, out)


def majority_label(pairs: list[tuple[str, Column]], total: Column) -> Column:
    """The label with more than half of a total, mixed if none has, null where the total is not above zero."""
    out = F.lit("mixed")
    for label, c in reversed(pairs):
        out = F.when(F.coalesce(c, F.lit(0.0)) * 2 > total, F.lit(label)).otherwise(out)
    return F.when(total > 0, out)


def name_matches(query: Column, name: Column) -> Column:
    """How a search text of two letters or more fits a name: 3 equal, 2 its start, 1 every word starts a word, 0 every word is contained, null not at all."""
    q, n = search_stripped(query), search_stripped(name)
    words, tokens = F.split(q, " "), F.split(n, " ")
    starts = F.forall(words, lambda w: F.exists(tokens, lambda t: F.startswith(t, w)))
    inside = F.forall(words, lambda w: F.contains(n, w))
    return F.when(F.length(search_text(query)) < 2, None).when(n == q, 3).when(F.startswith(n, q), 2).when(starts, 1).when(inside, 0)


def sparse_json(*fields: Column) -> Column:
    """JSON of fields that are neither null nor false."""
    return F.to_json(F.struct(*fields))


def truth(c: Column) -> Column:
    """true or null, so that JSON leaves false out."""
    return F.when(c, True)
