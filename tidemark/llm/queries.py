"""The numbered queries over the test tables, each through its operator, and DuckDB SQL where that can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import Template, format_chat, loss_text, read_chat
from .common import spread, table
from .decontam import contaminated
from .dedup import near_duplicates
from .html import main_text
from .langid import fit, identify
from .license import PHRASES, TEMPLATES, licenses, need, run_length, words_of
from .periodic import periodic_runs
from .quality import CLASSES, COMMON, GRAIN, Limits, quality
from .simhash import simhash_duplicates
from .spm import decode, encode
from .toxicity import fit as fit_toxicity
from .toxicity import toxicity
from .warc import read_warc, write_warc
from .whitening import whiten


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where((_part(5) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    out = toxicity(docs, fit_toxicity(docs, labels), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_part(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    out = quality(spread(table(spark, sf_dir, "documents")), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. A revisit's length and digest are those that its own record keeps."""
    out = read_warc(write_warc(table(spark, sf_dir, "pages")))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    own = F.col("record_type") == "response"
    return out.select(
        page("record_id").alias("page_id"), F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )


def _part(n: int):
    """The remainder by which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    learned = docs.where((_part(3) != 1) & F.col("lang").isNotNull()).select("text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(learned), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_part(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; ids_sha256 is of the ids as text, comma between."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == text).alias("round_trip"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings only, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))
    t = Template()
    out = format_chat(rows, t)
    out = out.select("conv_id", "valid", read_chat(F.col("formatted"), t).alias("turns"), loss_text(F.col("segments"), t).alias("loss"), "formatted")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"], windows=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document; in a tenth of them the words from some place on repeat, with a period that the document's id gives."""
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = periodic_runs(docs.select("doc_id", F.when((h % 10 == 0) & F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]")), _repeating(F.col("text"), F.floor(h / 10))).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _repeating(text: Column, g: Column) -> Column:
    """A text with words whose words from number g % n on are its next p again and again; p is a part of what is left."""
    words = F.split(F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), F.lit(" ")), " ")
    n = F.size(words)
    a = (g % n).cast("int")
    period = F.slice(words, a + 1, (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / F.size(period)).cast("int"))), F.lit(1), n - a)
    return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first sixteen components of all different ones."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and the component that its links make."""
    return simhash_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_format": op5_chat_format,
    "op6_main_text": op6_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontaminate": op9_decontaminate,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_simhash_dedup": op13_simhash_dedup,
}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op5() -> str:
    t = Template()
    escaped = lambda c: _swaps(c, t)
    moves = " ".join(f"when state = '{s}' and role = '{r}' then '{after}'" for s, to in t.moves.items() for r, after in to.items())
    ok = "</s>[INST] ok [/INST]"
    fixed = len(t.open) + len(t.after_role) + len(t.close)
    return f"""
    with recursive rows as (
      select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, null, 0, 'user', '{ok}' union all select -1, null, 1, 'assistant', '{ok}'
    ), n as (select *, row_number() over (partition by conv_id, alone order by turn nulls first, role, text) as i from rows),
    run as (
      select conv_id, alone, 0::bigint as i, '{t.start}' as state from n group by 1, 2
      union all
      select n.conv_id, n.alone, n.i, case {moves} else 'error' end from run join n on n.conv_id is not distinct from run.conv_id and n.alone is not distinct from run.alone and n.i = run.i + 1
    ), last as (select conv_id, alone, arg_max(state, i) as state from run group by 1, 2),
    told as (
      select conv_id, alone, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
        coalesce(string_agg(text, '' order by i) filter (where role in ({', '.join(map(_text, t.loss_roles))})), '') as loss,
        sum({fixed} + length({escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({escaped('text')}))::bigint as formatted_chars
      from n group by 1, 2
    )
    select told.conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars, state in ({', '.join(map(_text, t.accept))}) as valid
    from told join last on told.conv_id is not distinct from last.conv_id and told.alone is not distinct from last.alone"""


def _swaps(c: str, t: Template) -> str:
    for head in sorted({x[0] for x in t.controls}):
        rest = "|".join(re.escape(x[1:]) for x in t.controls if x[0] == head)
        c = f"regexp_replace({c}, {_text(f'({re.escape(head)})({chr(92) * 2}*(?:{rest}))')}, {_text(chr(92) + '1' + chr(92) * 2 + chr(92) + '2')}, 'g')"
    return c


WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op10() -> str:
    """Lines that hold enough of a template, and runs of words, line ends ignored, that do: a run begins at a word of the template and is as long as it may be."""
    sides = [(label, words_of(t), t) for label, texts in TEMPLATES.items() for t in texts]
    templates = ", ".join(f"({n}, {_text(label)}, [{', '.join(map(_text, ws))}], {need(len(ws), 0.9)}, {run_length(t, 0.9)})" for n, (label, ws, t) in enumerate(sides))
    places = ", ".join(f"list_transform(list_filter(generate_series(1, len(w)), lambda i: " + " and ".join(f"w[i + {k}] = {_text(p)}" for k, p in enumerate(phrase.split(" "))) + f"), lambda i: {{'i': i - 1, 'label': {_text(label)}}})" for phrase, label in PHRASES.items())
    return f"""
    with d as (select row_number() over () as r, doc_id, {LOWER} as t from documents),
    w as (select r, doc_id, regexp_extract_all(t, '{WORDS}') as w from d),
    p as (select r, doc_id, len(w)::bigint as n_words, flatten([{places}]) as p from w),
    blocks as (select distinct r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{WORDS}')) as b from d),
    t as (select * from (values {templates}) as t(id, label, ws, need, n)),
    m as (select r, label, max(len(list_intersect(b, ws)) / len(ws)) as c from blocks, t where len(list_intersect(b, ws)) >= need group by 1, 2),
    each as (select id, label, unnest(ws) as x, len(ws) as m, need, n from t),
    placed as (select r, i, w[i] as x from w, unnest(generate_series(1, len(w))) as u(i)),
    hit as (select r, id, label, i, placed.x, m, need, n from placed join each on each.x = placed.x),
    runs as (select one.r, one.label, one.m, one.need, count(distinct other.x) as k from hit as one join hit as other on one.r = other.r and one.id = other.id and other.i between one.i and one.i + one.n - 1 group by one.r, one.id, one.label, one.i, one.m, one.need),
    found as (select * from m union all select r, label, max(k / m) from runs where k >= need group by 1, 2),
    g as (select r, list(distinct label) as more, max(c) as c from found group by 1),
    o as (select p.*, coalesce(more, []) as more, c, list_distinct(list_transform(p, lambda x: x.label)) as base from p left join g on p.r = g.r)
    select doc_id, n_words, len(p)::bigint as n_base, list_min(list_transform(p, lambda x: x.i))::bigint as first_word, list_max(list_transform(p, lambda x: x.i))::bigint as last_word,
      array_to_string(list_sort(base), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') as labels,
      (case when len(base) > 0 then 1.0 else coalesce(c, 0.0) end)::double as score
    from o"""


def _op9() -> str:
    return f"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{WORDS}') as w from documents),
    b as (select coalesce(item_id::varchar, 'null') as item, regexp_extract_all({LOWER}, '{WORDS}') as w from benchmark),
    bw as (select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as x from b, unnest(generate_series(1, greatest(1, len(w) - 9))) as u(i) where len(w) > 0),
    dw as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as x from d, (select distinct n from bw) as s, unnest(generate_series(1, len(w) - n + 1)) as u(i)),
    h as (select r, i, n, item from dw join bw using (n, x)),
    hit as (select r, count(distinct k) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as k from h) group by 1),
    items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (r) left join items using (r)"""


OP2 = """
    with p as (select page_id, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as d from pages),
    f as (select d, min(page_id) as f from p where n >= 100 group by 1)
    select page_id, n as payload_bytes, p.d as payload_digest, case when page_id <> f then 'revisit' else 'response' end as record_type, case when page_id <> f then f end as refers_to
    from p left join f on p.d = f.d"""


def _op8() -> str:
    m = Limits()
    bins = ", ".join(f"length(regexp_replace(bare, {_text(f'[^{x}]+')}, '', 'g'))" for x in CLASSES.values())
    lists = ", ".join(f"({_text(k)}, [{', '.join(map(_text, v))}])" for k, v in COMMON.items())
    part = lambda x, y: f"case when z[{x}] > 0 then z[{x}] * log2(z[{x}] / ((z[1] + z[2]) / 2)) else 0 end"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part(1, 2)} + {part(2, 1)})) / 2))"
    middle = lambda src: f"select lang, list_transform(list(v order by i), lambda x: x / list_sum(list(v order by i))) as h from (select lang, i, quantile_disc(floor(v * {GRAIN}), 0.5) as v from (select lang, unnest(h) as v, generate_subscripts(h, 1) as i from {src}) group by 1, 2) group by 1"
    return f"""
    with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
    x as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from w, unnest(generate_series(1, len(w) - 2)) as u(i)),
    rep as (select r, count(distinct k) as n from (select r, unnest([i, i + 1, i + 2]) as k from x where n > 1) group by 1),
    b as (select w.r, doc_id, lang, t, len(w)::bigint as n_words, array_to_string(w, '') as bare, (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
      (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join rep on rep.r = w.r),
    f as (select *, length(bare)::bigint as word_chars, n_words < {m.min_words} or 100 * n_repeat_words > {m.max_repeat_percent} * n_words as base_failed, [{bins}] as known, string_split(regexp_replace(lower(t), '[^a-zß-ÿ]+', ' ', 'g'), ' ') as low from b),
    c as (select r, lang, n_words, base_failed, list_transform(list_append(known, word_chars - list_sum(known)), lambda k: coalesce(k / nullif(word_chars, 0), 0)) as h from f),
    lists as (select * from (values {lists}) as l(lang, words)),
    s as (select f.r, f.lang, l.lang as own, f.n_words, base_failed, list_transform(words, lambda k: least(1.0, coalesce(len(list_filter(low, lambda y: y = k)) / nullif(n_words, 0), 0))) as s from f join lists l on l.lang = f.lang or f.lang is null or f.lang not in (select lang from lists)),
    e as (select r, lang, own, n_words, base_failed, list_append(s, greatest(0, 1 - list_sum(s))) as h from s),
    rc as ({middle("(select c.lang, h from c where not base_failed and lang in (select lang from lists))")}), rw as ({middle("(select e.lang, h from e where not base_failed and lang = own)")}),
    dc as (select c.r, coalesce(min({js("c.h", "rc.h")}) filter (rc.lang = c.lang), min({js("c.h", "rc.h")})) as d from c, rc group by 1),
    dw as (select e.r, min({js("e.h", "rw.h")}) as d from e join rw on rw.lang = e.own where n_words >= {m.common_guard_words} group by 1)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not base_failed and not coalesce(dc.d > case when n_words >= {m.class_guard_words} then {m.max_class_distance} else {m.short_class_distance} end, false) and not coalesce(dw.d > {m.max_common_distance}, false) as kept
    from f left join dc on dc.r = f.r left join dw on dw.r = f.r"""


# Stretches of words that equal those q on are told by islands of equal five-word windows at that distance. crc32 goes bit by bit; 3988292384 is its polynomial.
OP11 = """
    with recursive ids as (select distinct doc_id, encode(doc_id::varchar) as b from documents where doc_id is not null),
    crc as (
      select doc_id, b, 0 as i, 4294967295::bigint as c from ids
      union all
      select doc_id, b, i + 1, case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end
      from (select doc_id, b, i, case when i % 8 = 0 then xor(c, ('0x' || hex(b[i // 8 + 1 : i // 8 + 1]))::bigint) else c end as x from crc where i < 8 * octet_length(b))
    ), h as (select doc_id, 4294967295 - c as h from crc where i = 8 * octet_length(b)),
    t as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    m as (select r, t.doc_id, w, len(w) as n, h // 10 as g, coalesce(h % 10 = 0 and len(w) > 0, false) as again, (h // 10) % greatest(1, len(w)) as a from t left join h on h.doc_id = t.doc_id),
    d as (select r, doc_id, n, case when again then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from m),
    x as (select r, n, i, hash(w[i + 1 : i + 5]) as k, w[i + 1 : i + 5] as v from d, unnest(range(n - 4)) as u(i)),
    same as (select x.r, x.i, y.i - x.i as q from x join x as y on x.r = y.r and x.k = y.k and x.v = y.v and y.i > x.i and 4 * (y.i - x.i) <= x.n),
    island as (select r, q, min(i) as start, count(*) + 4 + q as length from (select *, i - row_number() over (partition by r, q order by i) as o from same) group by r, q, o),
    runs as (select r, start, length, min(q) as period from island where length >= greatest(6, 4 * q) group by 1, 2, 3),
    gone as (select r, list(distinct k) as gone from (select r, unnest(range(start + period, start + length)) as k from runs) group by 1),
    told as (select r, count(*) as n_runs, arg_max((start, length, period), (length, -start, -period)) as b, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from runs group by 1)
    select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b[1]::bigint as start, b[2]::bigint as length, b[3]::bigint as period, (1000 * b[2] // b[3])::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256,
      sha256(coalesce(array_to_string(case when gone is null then w else list_transform(list_filter(range(n), lambda i: not list_contains(gone, i)), lambda i: w[i + 1]) end, ' '), '')) as collapsed_sha256
    from d left join told on told.r = d.r left join gone on gone.r = d.r"""

SQL: dict[str, str] = {
    "op8_quality_rules": _op8(),
    "op2_warc": OP2,
    "op9_decontaminate": _op9(),
    "op5_chat_format": _op5(),
    "op10_license_scan": _op10(),
    "op11_periodic_runs": OP11,
}
