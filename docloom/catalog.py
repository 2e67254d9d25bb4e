"""Queries over the given tables, by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import codec, color, digest, pii, records
from .functions import text as tx
from .operators import chunking, diagrams, health, layers, packing, prompts, publish, reports, scenario, search, similarity, snapshot, streaks, structure
from .sources import decks, html, kinds, theme

FLAGSHIP = "pii_email_by_lang"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


C = F.col
DAY = "cast('2024-02-01' as date)"
#: DuckDB forms of the text rules.
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NORM = STRIP.format(r"regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")
EMAIL = pii.BUILT_IN["email"]
LINES = r"(case when {0} = '' then []::varchar[] when ends_with({0}, chr(10)) then string_split({0}, chr(10))[:-2] else string_split({0}, chr(10)) end)"
FILLED = "list_filter(list_transform(" + LINES + r", lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _files(spark, d):
    """Documents as files: path, size, modified."""
    path = F.concat(C("source"), F.lit("/"), C("lang"), F.lit("/doc:"), C("doc_id").cast("string"), F.when(C("n_chars") > 2000, ".TXT").otherwise(".docx"))
    return _t(spark, d, "documents").select(path.alias("path"), C("n_chars").alias("size"), F.timestamp_seconds(C("n_chars") * 3600 + 1_600_000_000).alias("modified"), "doc_id", "source")


FILES = "(select source || '/' || lang || '/doc:' || doc_id || case when n_chars > 2000 then '.TXT' else '.docx' end as path, n_chars as size, make_timestamp((n_chars * 3600 + 1600000000) * 1000000) as modified, doc_id, source from documents)"


# -- text ---------------------------------------------------------------------


@query(f"select lang, count(*) as n_docs, count(*) filter (where h > 0) as flagged, sum(h)::bigint as hits from (select lang, len(regexp_extract_all({NORM}, '{EMAIL}')) as h from documents) group by lang")
def pii_email_by_lang(spark, d):
    hits = F.regexp_count(tx.normalize_text(C("text")), F.lit(EMAIL))
    return _t(spark, d, "documents").select("lang", hits.alias("h")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(C("h") > 0).alias("flagged"), F.sum("h").alias("hits"))


@query(f"select lang, count(*) as n, sum(length(t))::bigint as chars, sum(case when length(t) = 0 then 0 else greatest(1, round_even(length(t) / 1.4, 0)) end)::bigint as tokens from (select lang, {NORM} as t from documents) group by lang")
def normalize_stats(spark, d):
    t = tx.normalize_text(C("text"))
    return _t(spark, d, "documents").select("lang", F.length(t).alias("n"), tx.token_estimate(t).alias("k")).groupBy("lang").agg(F.count("*").alias("n_"), F.sum("n").alias("chars"), F.sum("k").alias("tokens")).withColumnRenamed("n_", "n")



@query("""
with f as (select doc_id, n_chars * n_chars as s from documents),
u as (select doc_id, s, case when s >= 1073741824 then 1073741824 when s >= 1048576 then 1048576 when s >= 1024 then 1024 else 1 end as k from f),
q as (select doc_id, s, k, (s * 100) // k as w, (s * 100) % k as r from u),
n as (select doc_id, s, k, w + case when r > k // 2 or (r = k // 2 and w % 2 = 1) then 1 else 0 end as w from q)
select doc_id, case when k = 1 then s || ' B' else (w // 100) || '.' || lpad((w % 100)::varchar, 2, '0') || case k when 1024 then ' KB' when 1048576 then ' MB' else ' GB' end end as size_text from n""")
def size_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.format_size(C("n_chars") * C("n_chars")).alias("size_text"))


@query(f"""select doc_id, regexp_replace(path, '[\\\\/:*?"<>|]', '_', 'g') as name, case when contains(path, '/') then split_part(path, '/', 1) else '_root' end as grp, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as extension, starts_with(path, 'src1/') as under_src1 from {FILES}""")
def file_names(spark, d):
    p = C("path")
    return _files(spark, d).select("doc_id", tx.clean_filename(p).alias("name"), tx.group_key(p).alias("grp"), tx.extension(p).alias("extension"), tx.is_same_or_child(p, F.lit("src1")).alias("under_src1"))


@query(f"""
with t as (select doc_id, text, {NORM} as n from documents),
l as (select doc_id, text, n, {FILLED.format('n')} as f, {FILLED.format('text')} as o from t)
select doc_id, md5(case when n = '' then '{tx.NO_TEXT}' when length(array_to_string(f[:20], chr(10))) > 1200 then left(array_to_string(f[:20], chr(10)), 1200) || '...' else array_to_string(f[:20], chr(10)) end) as summary,
case when length(text) > 300 then left(text, 300) || '...' else text end as excerpt,
case when length(array_to_string(o, ' / ')) > 160 then left(array_to_string(o, ' / '), 160) || '...' else array_to_string(o, ' / ') end as one_line from l""")
def summaries(spark, d):
    t = C("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.plain_summary(t)).alias("summary"), tx.excerpt(t).alias("excerpt"), tx.one_line(t).alias("one_line"))


_HEADS = f"regexp_matches(x, '{tx.HEADING}')"


@query(f"""
with t as (select doc_id, text, {NORM} as n from documents),
l as (select doc_id, text, {FILLED.format('n')} as f from t),
p as (select doc_id, text, f, list_filter(f, lambda x: {_HEADS})[:30] as h, list_filter(f, lambda x: not {_HEADS})[:8] as b from l),
q as (select *, list_transform(h, lambda x: {STRIP.format("regexp_replace(x, '^#+', '')")}) as heads, list_reduce(list_concat([''], b), lambda a, x: case when length(a) > 400 then a when a = '' then x else a || chr(10) || x end) as lead, right(text, 200) as r from p),
s as (select *, concat_ws(chr(10), case when len(heads) > 0 then '見出し: ' || array_to_string(heads, ' / ') end, nullif(lead, '')) as s from q)
select doc_id, case when len(f) = 0 then '{tx.NO_TEXT}' when length(s) > 1200 then left(s, 1200) || '...' else s end as summary,
trim(substr(r, strpos(r, chr(10)) + 1), chr(10)) as tail, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))) + 1, 3))) as fence from s""")
def heading_summaries(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.heading_summary(C("text")).alias("summary"), tx.line_tail(C("text"), 200).alias("tail"), tx.code_fence(C("text")).alias("fence"))


@query(f"select doc_id, sha256(array_to_string(list_filter({LINES.format('text')}, lambda x: not starts_with(x, 'GeneratedAt:') and not starts_with(x, '- 生成日時:')), chr(10))) as sha from documents")
def content_hashes(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.content_hash(C("text")).alias("sha"))


# -- sensitive values -----------------------------------------------------------


@query()
def pii_findings(spark, d):
    return pii.merge_findings(_t(spark, d, "documents").select(pii.scan(tx.normalize_text(C("text")), ["token"]).alias("findings")))


@query(f"select doc_id, md5(regexp_replace(text, '{EMAIL}', '{pii.MASK}', 'g')) as masked, len(regexp_extract_all(text, '{EMAIL}')) as n from documents")
def pii_mask_email(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", EMAIL, pii.MASK)).alias("masked"), F.regexp_count("text", F.lit(EMAIL)).cast("long").alias("n"))


@query("""
select doc_id, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) between 15 and 16)) as long_runs,
len(list_filter(regexp_extract_all(text, '-?[0-9]+'), lambda x: length(x) = 12 and not starts_with(x, '-'))) as twelve from documents""")
def pii_long_digits(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return _t(spark, d, "documents").select("doc_id", count(r"(?<!\d)\d{15,16}(?!\d)").alias("long_runs"), count(r"(?<![\d-])\d{12}(?!\d)").alias("twelve"))


def _masked_sql(expr: str, *shapes: tuple[str, str, str]) -> str:
    """SQL that masks shapes (before, itself, behind); a neighbour may be shared by two, so every shape is looked for twice."""
    for before, own, behind in shapes:
        for _ in range(2):
            expr = f"regexp_replace({expr}, '({before})(?:{own})({behind})', '\\1＜伏字＞\\2', 'g')"
    return expr


_KINDS_SQL = {
    "card": _masked_sql("text", ("^|[^0-9-]", "[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}", "$|[^0-9-]"), ("^|[^0-9]", "[0-9]{15,16}", "$|[^0-9]")),
    "my_number": _masked_sql("card", ("^|[^0-9-]", "[0-9]{12}", "$|[^0-9]"), ("^|[^0-9-]", "[0-9]{4}-[0-9]{4}-[0-9]{4}", "$|[^0-9-]|-$|-[^0-9]")),
    "phone": _masked_sql("my_number", ("^|[^0-9-]", "0[0-9]{1,4}-[0-9]{1,4}-[0-9]{4}", "$|[^0-9-]")),
    "email": "regexp_replace(phone, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '＜伏字＞', 'g')",
}
_SEEN_SQL = {k: f"(length({k}) - length(replace({k}, '＜伏字＞', ''))) // 4 - (length({b}) - length(replace({b}, '＜伏字＞', ''))) // 4" for b, k in zip(("text", *_KINDS_SQL), _KINDS_SQL)}


@query(f"""
with {', '.join(f"m{i} as (select *, {sql} as {k} from {'documents' if i == 0 else f'm{i - 1}'})" for i, (k, sql) in enumerate(_KINDS_SQL.items()))}
select doc_id, md5(email) as masked, '{{' || concat_ws(',', {', '.join(f"case when {n} > 0 then '{chr(34)}{k}{chr(34)}:' || ({n}) end" for k, n in _SEEN_SQL.items())}) || '}}' as counts from m3""")
def pii_masked(spark, d):
    t = C("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(pii.mask(t)).alias("masked"), F.to_json(pii.mask_counts(t)).alias("counts"))


@query(f"select c.conv_id, c.turn from conversations c where len(regexp_extract_all(text, '{EMAIL}')) = 0")
def pii_unblocked_turns(spark, d):
    return _t(spark, d, "conversations").where(~C("text").rlike(EMAIL)).select("conv_id", "turn")


# -- digest ---------------------------------------------------------------------


@query(f"""
with l as (select doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as line from (select doc_id, unnest({LINES.format('text')}) as x, generate_subscripts({LINES.format('text')}, 1) as i from documents)),
c as (select doc_id, line, count(*) as n, min(i) as f from l where length(line) >= 30 and not starts_with(line, '#') group by doc_id, line having count(*) > 1),
r as (select doc_id, md5(line) as line, n, row_number() over (partition by doc_id order by n desc, f)::int as rank from c)
select * from r where rank <= 20""")
def repeated_lines(spark, d):
    return digest.repeated_lines(_t(spark, d, "documents")).withColumn("line", F.md5("line"))


@query(r"""
with m as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?:19|20)\d{2}[/-]\d{1,2}(?:[/-]\d{1,2})?'), lambda x: trim(x))) as a,
  list_distinct(regexp_extract_all(text, '(?:Rev|Ver|ver|版数)[.．]?\s*[0-9]+(?:\.[0-9]+)?')) as b from documents)
select doc_id, (len(a) + len(list_filter(b, lambda x: not list_contains(a, x))))::int as n_mentions, list_max(list_transform(list_filter(list_concat(a, b), lambda x: regexp_matches(x, '(19|20)\d{2}')), lambda x: regexp_extract(x, '(19|20)\d{2}')::int)) as newest_year from m""")
def date_mentions(spark, d):
    t = C("text")
    return _t(spark, d, "documents").select("doc_id", F.size(digest.date_mentions(t)).alias("n_mentions"), digest.newest_year(t).alias("newest_year"))


@query(f"""
with b as (select doc_id, array_to_string(list_filter({LINES.format('text')}, lambda x: not starts_with(x, '#')), chr(10)) as t from documents),
s as (select doc_id, list_filter(list_transform(string_split_regex(t, '[.\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from b),
a as (select doc_id, case when len(s) = 0 then 0.0 else list_sum(list_transform(s, lambda x: length(x)))::double / len(s) end as a from s)
select doc_id, round(a, 6) as avg_sentence_length, case when a <= 0 then 'unknown' when a < 35 then 'easy' when a < 55 then 'normal' else 'hard' end as readability from a""")
def sentence_lengths(spark, d):
    a = digest.average_sentence(C("text"), ".")
    return _t(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", F.round("a", 6).alias("avg_sentence_length"), digest.readability(C("a")).alias("readability"))


@query()
def document_digest(spark, d):
    got = digest.digest(_t(spark, d, "documents"))
    return got.select("doc_id", F.size("headings").alias("n_headings"), F.size("date_mentions").alias("n_dates"), "newest_year", F.size("broken_references").alias("n_broken"), F.size("repeated_lines").alias("n_repeated"), "avg_sentence_length", "char_count", "line_count", digest.is_stale(C("newest_year"), F.expr(DAY)).alias("stale"))


_ENDS = ("手順", "基準", "の注意点", "")
_ASKED = "case " + " ".join(f"when regexp_matches(core, '{p}') then '{q}'" for p, q in digest.QUESTIONS) + f" else '{digest.OTHER_QUESTION}' end"


@query(f"""
with l as (select doc_id, unnest({LINES.format('text')}) as x, generate_subscripts({LINES.format('text')}, 1) as pos, ['{"', '".join(_ENDS)}'][doc_id % 4 + 1] as e from documents),
h as (select doc_id, pos, {STRIP.format('(x || e)')} as title from l where length(x) between 1 and 40),
c as (select *, {STRIP.format("regexp_replace(title, '^[0-9.]+[ ]*', '')")} as core from h where not regexp_matches(title, '{digest.MACHINE_TITLES}')),
f as (select doc_id, core, min(pos) as pos, arg_min(title, pos) as title from c where length(core) >= 3 group by doc_id, core),
r as (select *, row_number() over (partition by doc_id order by pos)::int as rank from f)
select doc_id, rank, core || {_ASKED} as question, title from r where rank <= 12""")
def document_questions(spark, d):
    """Short lines as headings, with endings that ask for different questions."""
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (C("doc_id") % 4 + 1).cast("int"))
    #: other lines are no headings here, even if they are numbered
    only = lambda x: F.when(F.length(x).between(1, 40), F.concat(F.lit("# "), x, end)).otherwise("")
    as_headings = F.array_join(F.transform(F.split("text", "\n"), only), "\n")
    return digest.questions(_t(spark, d, "documents").select("doc_id", digest.headings(as_headings).alias("headings")))


# -- duplicates -------------------------------------------------------------------


@query(f"select sha256(lower({NORM})) as sha, count(*) as n, min(doc_id) as first, max(doc_id) as last from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    return similarity.exact_duplicates(_t(spark, d, "documents"))


@query(f"select doc_id, row_number() over (partition by sha256(lower({NORM})) order by n_chars desc, lpad(doc_id::varchar, 12, '0') desc) = 1 as keep from documents")
def keep_latest(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "n_chars", F.lpad(C("doc_id").cast("string"), 12, "0").alias("path"), F.sha2(F.lower(tx.normalize_text(C("text"))), 256).alias("grp"))
    return similarity.keep_latest(rows, "grp", "n_chars", "path").select("doc_id", "keep")


@query()
def near_dup_pairs(spark, d):
    return similarity.similar_pairs(similarity.signatures(_t(spark, d, "documents").select("doc_id", "text")))


@query()
def near_dup_groups(spark, d):
    return similarity.similar_groups(similarity.signatures(_t(spark, d, "documents").select("doc_id", "text")))


# -- chunks and parts ---------------------------------------------------------------


@query(f"""
with t as (select doc_id, {NORM} as n from documents),
l as (select doc_id, list_transform({LINES.format('n')}, lambda x: {{'done': []::varchar[], 'held': x, 'room': 0::bigint}}) as ls from t),
r as (select doc_id, list_reduce(list_concat([{{'done': []::varchar[], 'held': null::varchar, 'room': 1000::bigint}}], ls), lambda a, x:
  case when length(x.held) + 1 > 1000 then {{'done': list_concat(a.done, case when a.held is null then [] else [a.held] end, list_transform(range(0, length(x.held), 1000), lambda i: substr(x.held, i + 1, 1000))), 'held': null, 'room': 1000}}
  when a.held is null then {{'done': a.done, 'held': x.held, 'room': a.room - length(x.held) - 1}}
  when length(x.held) + 1 > a.room then {{'done': list_append(a.done, a.held), 'held': x.held, 'room': 1000 - length(x.held) - 1}}
  else {{'done': a.done, 'held': a.held || chr(10) || x.held, 'room': a.room - length(x.held) - 1}} end) as s from l),
c as (select doc_id, case when s.held is not null then list_append(s.done, s.held) when len(s.done) = 0 then [''] else s.done end as parts from r)
select doc_id, unnest(range(1, len(parts) + 1))::int as chunk_index, len(parts)::int as chunk_count, md5(unnest(parts)) as text from c""")
def chunks_by_lines(spark, d):
    return chunking.chunk(_t(spark, d, "documents"), "lines", 1000).select("doc_id", "chunk_index", "chunk_count", F.md5("text").alias("text"))


#: A text's lines packed into at most 1000 characters with their line ends, longer ones cut.
_BY_LINES = """list_filter(list_transform([list_reduce(list_concat([{{'done': []::varchar[], 'held': null::varchar, 'room': 1000::bigint}}], list_transform({list_lines}, lambda x: {{'done': []::varchar[], 'held': x, 'room': 0::bigint}})), lambda a, x:
  case when length(x.held) + 1 > 1000 then {{'done': list_concat(a.done, case when a.held is null then [] else [a.held] end, list_transform(range(0, length(x.held), 1000), lambda i: substr(x.held, i + 1, 1000))), 'held': null, 'room': 1000}}
  when a.held is null then {{'done': a.done, 'held': x.held, 'room': a.room - length(x.held) - 1}}
  when length(x.held) + 1 > a.room then {{'done': list_append(a.done, a.held), 'held': x.held, 'room': 1000 - length(x.held) - 1}}
  else {{'done': a.done, 'held': a.held || chr(10) || x.held, 'room': a.room - length(x.held) - 1}} end)], lambda r: case when r.held is null then r.done else list_append(r.done, r.held) end)[1], lambda x: true)"""
#: A chunk is full; then the next begins with the whole lines of its last 120 characters.
_FULL = "a.held <> '' and length(a.held) + 1 + length(x.held) > 1000"
_TAIL = "trim(case when contains(right(a.held, 120), chr(10)) then substr(right(a.held, 120), strpos(right(a.held, 120), chr(10)) + 1) else right(a.held, 120) end, chr(10))"
_TAILED = f"(case when {_TAIL} = '' then x.held else {_TAIL} || chr(10) || x.held end)"


@query(f"""
with t as (select doc_id, {NORM} as n from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (select doc_id, {LINES.format('n')} as ls from t)),
h as (select *, sum((pos = 1 or regexp_matches(line, '^#{{1,4}} '))::int) over (partition by doc_id order by pos) as section from l),
s as (select doc_id, section, string_agg(line, chr(10) order by pos) as body from h group by doc_id, section),
p as (select doc_id, section, case when length(body) <= 1000 then [body] else list_transform(string_split(body, chr(10) || chr(10)), lambda x: x) end as ps, length(body) <= 1000 as whole from s),
g as (select doc_id, section, case when whole then ps else list_filter(list_append(r.done, r.held), lambda x: x <> '') end as ps from (select *, list_reduce(list_transform(ps, lambda x: {{'done': []::varchar[], 'held': x}}), lambda a, x:
  case when a.held = '' then {{'done': a.done, 'held': x.held}} when length(a.held) + 2 + length(x.held) <= 1000 then {{'done': a.done, 'held': a.held || chr(10) || chr(10) || x.held}} else {{'done': list_append(a.done, a.held), 'held': x.held}} end) as r from p)),
q as (select doc_id, section, unnest(ps) as para, generate_subscripts(ps, 1) as nth from g),
c as (select doc_id, section, nth, case when length(para) <= 1000 then [para] else {_BY_LINES.format(list_lines=LINES.format('para'))} end as bs from q),
b as (select doc_id, list(block order by section, nth, k) as bs from (select doc_id, section, nth, unnest(bs) as block, generate_subscripts(bs, 1) as k from c) group by doc_id),
f as (select doc_id, list_reduce(list_concat([{{'done': []::varchar[], 'held': ''}}], list_transform(bs, lambda x: {{'done': []::varchar[], 'held': x}})), lambda a, x:
  case when {_FULL} then case when length({_TAILED}) > 1000 then {{'done': list_concat(a.done, [a.held, left({_TAILED}, 1000)]), 'held': substr({_TAILED}, 1001)}} else {{'done': list_append(a.done, a.held), 'held': {_TAILED}}} end
  when a.held = '' then {{'done': a.done, 'held': x.held}} else {{'done': a.done, 'held': a.held || chr(10) || x.held}} end) as r from b),
o as (select t.doc_id, case when r.held <> '' then list_append(r.done, r.held) when len(r.done) > 0 then r.done else [''] end as parts from t left join f using (doc_id))
select doc_id, unnest(range(1, len(parts) + 1))::int as chunk_index, len(parts)::int as chunk_count, md5(unnest(parts)) as text from o""")
def chunks_by_sections(spark, d):
    return chunking.chunk(_t(spark, d, "documents"), "sections", 1000).select("doc_id", "chunk_index", "chunk_count", F.md5("text").alias("text"))


def _sections(spark, d):
    return _t(spark, d, "documents").select(C("source").alias("grp"), C("doc_id").alias("ord"), (C("n_chars") + 2).alias("size"))


@query("""
with recursive i as (select source as grp, doc_id as ord, n_chars + 2 as size, row_number() over (partition by source order by doc_id) as k from documents),
r as (
  select grp, ord, size, k, 1 as now, size as used, 1 as part from i where k = 1
  union all
  select i.grp, i.ord, i.size, i.k,
    case when r.used > 0 and r.used + i.size > 30000 and r.now < 19 then r.now + 1 else r.now end,
    case when r.used > 0 and r.used + i.size > 30000 then case when r.now < 19 then i.size else r.used end else r.used + i.size end,
    case when r.used > 0 and r.used + i.size > 30000 then case when r.now < 19 then r.now + 1 else null end else r.now end
  from r join i on i.grp = r.grp and i.k = r.k + 1)
select grp, ord, size, part::int as part from r""")
def parts_sequential(spark, d):
    return packing.pack(_sections(spark, d))


@query("""
with recursive i as (select source as grp, doc_id as ord, n_chars + 2 as size, row_number() over (partition by source order by doc_id) as k from documents),
r as (
  select grp, ord, size, k, [size::bigint] as used, 1 as part from i where k = 1
  union all
  select grp, ord, size, k, case when j <= len(used) then list_concat(used[:j - 1], [used[j] + size], used[j + 1:]) when j <= 19 then list_append(used, size) else used end, case when j <= 19 then j end
  from (select i.grp, i.ord, i.size, i.k, r.used, coalesce(list_position(r.used, list_max(list_filter(r.used, lambda u: u = 0 or u + i.size <= 30000))), len(r.used) + 1) as j from r join i on i.grp = r.grp and i.k = r.k + 1))
select grp, ord, size, part::int as part from r""")
def parts_bestfit(spark, d):
    return packing.pack(_sections(spark, d), "bestfit")


@query("""
with recursive i as (select source as grp, doc_id as ord, n_chars + 2 as size, row_number() over (partition by source order by doc_id) as k from documents),
r as (
  select grp, ord, size, k, 200 + size + 1 as used, 1 as part from i where k = 1
  union all
  select i.grp, i.ord, i.size, i.k, case when r.used + i.size > 120000 then 200 + i.size + 1 else r.used + i.size + 1 end, case when r.used + i.size > 120000 then r.part + 1 else r.part end
  from r join i on i.grp = r.grp and i.k = r.k + 1)
select grp, part::int as part, count(*) as n_items, sum(size)::bigint as chars from r group by grp, part""")
def markdown_parts(spark, d):
    return packing.part_totals(packing.pack(_sections(spark, d), "rollover", packing.MARKDOWN_CHARS, 200))


# -- runs ---------------------------------------------------------------------------


def _runs(spark, d):
    """Two states of the same collection: what was labelled, and what is there."""
    previous = _t(spark, d, "labels").select(C("doc_id").alias("path"), C("quality").alias("size"), C("toxic").alias("mtime"))
    return previous, _t(spark, d, "documents").select(C("doc_id").alias("path"), (C("n_chars") > 1000).cast("int").alias("size"), F.lit(0).alias("mtime"))


@query("""
select coalesce(c.doc_id, p.doc_id) as path, case when p.doc_id is null then 'added' when c.doc_id is null then 'removed' else 'changed' end as change
from labels p full join documents c on c.doc_id = p.doc_id
where p.doc_id is null or c.doc_id is null or (c.n_chars > 1000)::int is distinct from p.quality or p.toxic is distinct from 0""")
def snapshot_diff(spark, d):
    return snapshot.diff(*_runs(spark, d))


@query("select d.doc_id as path, (d.n_chars > 1000)::int as size, 0 as mtime, p.doc_id is not null as hit from documents d left join labels p on p.doc_id = d.doc_id and p.quality = (d.n_chars > 1000)::int and p.toxic = 0")
def cache_lookup(spark, d):
    cache, files = _runs(spark, d)
    return snapshot.cache_hits(files, cache).select("path", "size", "mtime", "hit")


@query("select doc_id as path, n_chars as size from documents where doc_id in (select doc_id from labels)")
def cache_cleanup(spark, d):
    inventory, _ = _runs(spark, d)
    return snapshot.cache_without_gone(_t(spark, d, "documents").select(C("doc_id").alias("path"), C("n_chars").alias("size")), inventory)


@query("""
with c as (select source as file_name, md5(sum(n_chars)::varchar) as sha from documents group by source),
p as (select coalesce(d.source, 'gone') as file_name, md5(sum(d.n_chars)::varchar) as sha from labels l left join documents d using (doc_id) group by 1)
select coalesce(c.file_name, p.file_name) as file_name, case when p.sha is null then 'new' when c.sha is null then 'removed' when c.sha = p.sha then 'unchanged' else 'changed' end as state from p full join c on c.file_name = p.file_name""")
def upload_note(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    sha = F.md5(F.sum("n_chars").cast("string")).alias("sha")
    was = _t(spark, d, "labels").join(docs, "doc_id", "left").groupBy(F.coalesce("source", F.lit("gone")).alias("file_name")).agg(sha)
    return snapshot.upload_note(was, docs.groupBy(C("source").alias("file_name")).agg(sha))


@query("select event_id, ts from events order by event_id desc limit 400")
def last_events(spark, d):
    return snapshot.last_runs(_t(spark, d, "events").select("event_id", "ts"), 400, "event_id")


@query("""
with s as (select d.source, count(*) as previous, count(*) filter (where l.quality = 1) as new from documents d left join labels l using (doc_id) group by d.source)
select source, previous, new, case when new = 0 then 'hold: no chunks' when new / previous < 0.5 then 'hold: too few chunks' else 'ok' end as reason, not (new = 0 or new / previous < 0.5) as publish from s""")
def publish_decisions(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id", "left")
    rows = j.groupBy("source").agg(F.count("*").alias("previous"), F.count_if(C("quality") == 1).alias("new"))
    return publish.decide(rows, F.lit(False), F.lit(False), F.lit(True), C("previous"), C("new"))


# -- health ---------------------------------------------------------------------------


def _outcomes(spark, d):
    status = F.when(C("quality") == 1, "ok").when(C("toxic") == 1, "protected").when(C("quality") == 0, "partial").otherwise("empty")
    return _files(spark, d).join(_t(spark, d, "labels"), "doc_id", "left").select("path", "size", status.alias("status"), F.when(C("size") % 7 > 0, C("modified")).alias("modified"), F.when(C("quality").isNotNull(), C("size")).otherwise(0).alias("units_total"), F.when(C("quality") == 1, C("size")).otherwise(0).alias("units_ok"))


OUTCOMES = f"(select path, size, case when quality = 1 then 'ok' when toxic = 1 then 'protected' when quality = 0 then 'partial' else 'empty' end as status, case when size % 7 > 0 then modified end as modified, case when quality is not null then size else 0 end as units_total, case when quality = 1 then size else 0 end as units_ok from {FILES} left join labels using (doc_id))"
BUCKET = "case when modified is null then 'unknown' when floor((epoch(cast('2024-02-01' as timestamp)) - epoch(modified)) / 86400) / 365.25 < 1 then 'under_1' when floor((epoch(cast('2024-02-01' as timestamp)) - epoch(modified)) / 86400) / 365.25 < 3 then 'under_3' else 'over_3' end"


@query(f"select status, count(*) as n from {OUTCOMES} group by status")
def status_rollup(spark, d):
    return health.status_counts(_outcomes(spark, d))


@query(f"select sum(units_ok)::bigint as units_ok, sum(units_total)::bigint as units_total, sum(units_ok) / sum(units_total) as coverage from {OUTCOMES} where units_total > 0")
def coverage(spark, d):
    return health.coverage(_outcomes(spark, d))


@query(f"select lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as extension, count(*) as n_files, sum(size)::bigint as bytes from {FILES} group by 1")
def extension_counts(spark, d):
    return health.extension_counts(_files(spark, d).withColumn("extension", tx.extension(C("path"))))


@query(f"select {BUCKET} as bucket, count(*) as n from {OUTCOMES} group by 1")
def age_buckets(spark, d):
    return _outcomes(spark, d).groupBy(health.age_bucket(C("modified"), F.expr(DAY)).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""
with o as (select status, {BUCKET} as bucket from {OUTCOMES}),
x as (select count(*) - count(distinct sha256(lower({NORM}))) as dup, sum(len(regexp_extract_all({NORM}, '{EMAIL}'))) as found from documents),
s as (select round_even(40 * (count(*) filter (where status in ('ok', 'partial'))) / count(*), 0)::int as readable,
  round_even(20 * (count(*) filter (where bucket in ('under_1', 'under_3'))) / (count(*) filter (where bucket <> 'unknown')), 0)::int as freshness,
  round_even(15 * greatest(0.0, 1 - (select dup from x) / count(*)), 0)::int as uniqueness, 15 as capacity, case when (select found from x) > 0 then 4 else 10 end as safety from o),
t as (select *, readable + freshness + uniqueness + capacity + safety as total from s)
select *, case when total >= 85 then 'A' when total >= 70 then 'B' when total >= 50 then 'C' else 'D' end as grade from t""")
def health_score(spark, d):
    text = tx.normalize_text(C("text"))
    docs = _t(spark, d, "documents").select(F.sha2(F.lower(text), 256).alias("sha"), F.regexp_count(text, F.lit(EMAIL)).alias("hits"))
    found = docs.groupBy("sha").agg((F.count("*") - 1).alias("dup"), F.sum("hits").alias("hits")).agg(F.sum("dup").alias("dup"), F.sum("hits").alias("hits")).first()
    return health.health_score(_outcomes(spark, d), F.expr(DAY), F.lit(found["dup"] or 0), F.lit(0), F.lit(found["hits"] or 0))


# -- search ---------------------------------------------------------------------------


@query(f"""
with t as (select doc_id, {NORM} as t from documents),
h as (select doc_id, t, strpos(lower(t), 'the') - 1 as p from t where contains(lower(t), 'the') and contains(lower(t), 'tion'))
select doc_id, replace(substr(t, greatest(0, p - 80) + 1, p + 160 - greatest(0, p - 80)), chr(10), ' / ') as excerpt from h""")
def content_search(spark, d):
    return search.by_content(_t(spark, d, "documents"), "the TION", None)


@query(f"select path from {FILES} where contains(lower(path), 'src1') and contains(lower(path), 'en') and lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = '.txt' order by path limit 100")
def name_search(spark, d):
    return search.by_name(_files(spark, d), "SRC1 en", (".txt",)).select("path")


@query("select event_id, ts from events where ts >= (select max(ts) from events) - interval 7 day order by ts desc, event_id desc limit 100")
def recent_events(spark, d):
    events = _t(spark, d, "events").select("event_id", "ts")
    last = events.agg(F.max("ts")).first()[0]
    return search.recent(events, F.lit(last), 7, 100, "ts", "event_id")


@query(f"select doc_id, substr(t, 501, 1000) as text, length(t)::int as total, case when length(t) > 1500 then 1500 end as next from (select doc_id, {NORM} as t from documents)")
def text_pages(spark, d):
    return _t(spark, d, "documents").select("doc_id", search.page(C("text"), 500, 1000).alias("p")).select("doc_id", "p.*")


# -- scenarios --------------------------------------------------------------------------


_SCEN = " union all ".join(f"select '{n}' as scenario, {v}::double as ml_per_prompt" for n, v in scenario.SCENARIOS)
_COMP = " union all ".join(f"select {i} as rank, '{n}' as comparison, {v!r}::double as comparison_ml, {str(ok).lower()} as verified" for i, (n, v, ok) in enumerate(scenario.COMPARISONS) if n not in scenario.NOT_TELLING)
_VESS = " union all ".join(f"select {i} as rank, '{n}' as vessel, {v!r}::double as vessel_ml, {m} as max_copies" for i, (n, v, m) in enumerate(scenario.VESSELS))


def _volumes(spark, d):
    n = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.crossJoin(scenario.scenarios(spark)).select("user_id", "scenario", (C("n") * C("ml_per_prompt")).alias("ml"))


VOLUMES = f"(select user_id, scenario, n * ml_per_prompt as ml from (select user_id, count(*) as n from events group by user_id) cross join ({_SCEN}))"


@query(f"""
with v as {VOLUMES}, c as ({_COMP}),
j as (select v.user_id, v.scenario, v.ml, arg_max(c, c.rank) as c from v join c on v.ml / c.comparison_ml >= 1 or c.rank = 0 group by all)
select user_id, scenario, ml, c.comparison as comparison, ml / c.comparison_ml as times, c.verified as verified from j""")
def water_by_user(spark, d):
    return scenario.most_telling(_volumes(spark, d), "ml", ["user_id", "scenario"])


@query(f"""
with v as (select user_id, scenario, ml * 1000 as ml from {VOLUMES}), s as ({_VESS}),
j as (select v.user_id, v.scenario, v.ml, arg_min(s, s.rank) as s from v join s on ceil(v.ml / s.vessel_ml) <= s.max_copies or s.rank = 5 group by all)
select user_id, scenario, ml, s.vessel as vessel, ceil(ml / s.vessel_ml)::bigint as copies from j""")
def vessel_stage(spark, d):
    return scenario.vessel_stage(_volumes(spark, d).withColumn("ml", C("ml") * 1000), "ml", ["user_id", "scenario"])


@query(f"select r_regionkey as region, n_nationkey as nation, scenario, (r_regionkey + 1) * (n_nationkey + 1) * 30 * ml_per_prompt as ml, 2.5e9 * ml_per_prompt / 1000 / 86400 as world_lps from region cross join nation cross join ({_SCEN})")
def volume_ladder(spark, d):
    per_day, people = _t(spark, d, "region").select((C("r_regionkey") + 1).alias("per_day")), _t(spark, d, "nation").select((C("n_nationkey") + 1).alias("people"))
    got = scenario.ladder(per_day, people, spark.range(1).select(F.lit(30).alias("days")))
    return got.select((C("per_day") - 1).alias("region"), (C("people") - 1).alias("nation"), "scenario", "ml", scenario.rate_lps(C("ml_per_prompt"), F.lit(scenario.PROMPTS_PER_DAY)).alias("world_lps"))


@query("""
with e as (select user_id, ts, event_id, value, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events)
select user_id, round(sum((epoch_us(coalesce(nxt, timestamp '2024-02-01 00:00:00')) - epoch_us(ts)) / 1e6 * value), 3) as total from e group by user_id""")
def piecewise_total(spark, d):
    got = scenario.running_total(_t(spark, d, "events"), ["user_id"], F.lit("2024-02-01 00:00:00").cast("timestamp"), "ts", "value", ("ts", "event_id"))
    return got.withColumn("total", F.round("total", 3))


@query(f"""
with v as {VOLUMES}, l as (select *, ml / 1000 as l from v),
u as (select *, case when ml < 1000 then ml when l < 1e4 then l else l / 1e4 end as x, case when ml < 1000 then 'mL' when l < 1e4 then 'L' else '万 L' end as unit from l)
select user_id, scenario, case when abs(x - round(x)) < 1e-9 then format('{{:,.0f}}', x) when x < 10 then format('{{:,.2f}}', round(x, 2)) when x < 100 then format('{{:,.1f}}', round(x, 1)) else format('{{:,.0f}}', round(x, 0)) end || ' ' || unit as volume from u""")
def volume_texts(spark, d):
    return _volumes(spark, d).select("user_id", "scenario", scenario.volume_text(C("ml")).alias("volume"))


@query("""select event_id, case when s >= 3600 then (s // 3600) || ':' || lpad(((s % 3600) // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else lpad((s // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') end as duration, round(log10(value + 1) / 4, 9) as position, floor(value * 1000 / 30000)::bigint as ticks
from (select event_id, value, greatest(0, floor(value * 1000 * 60 / 1000))::bigint as s from events)""")
def event_scales(spark, d):
    ms = C("value") * 1000
    return _t(spark, d, "events").select("event_id", scenario.duration_text(ms * 60).alias("duration"), F.round(scenario.log_position(C("value") + 1, 1.0, 10_000.0), 9).alias("position"), scenario.catch_up(ms, F.lit(0), 30_000)["n"].alias("ticks"))


# -- days -----------------------------------------------------------------------------------


def _days(spark, d):
    return _t(spark, d, "events").select("user_id", cal.jst_day(C("ts")).alias("day"))


DAYS = "(select distinct user_id, cast(ts + interval 9 hour as date) as day from events)"


@query(f"""
with d as {DAYS}, t as (select max(day) as today from d),
i as (select user_id, day, day - (row_number() over (partition by user_id order by day))::int as a from d),
s as (select user_id, min(day) as f, max(day) as l, count(*) as n from i group by user_id, a)
select user_id, least(400, max(case when l >= today and f <= today then today - f + 1 when l = today - 1 then n else 0 end))::int as streak from s cross join t group by user_id""")
def daily_streak(spark, d):
    days = _days(spark, d)
    today = days.agg(F.max("day")).first()[0]
    return streaks.streak(days, ["user_id"], F.lit(today))


@query(f"""
with d as {DAYS}, s as (select user_id, min(day) as start, min(day) + 2 as "end" from d group by user_id),
n as (select s.user_id, s.start, s."end", count(*) filter (where day between s.start and s."end") as n_days from s join d using (user_id) group by s.user_id, s.start, s."end")
select *, n_days >= 3 and "end" <= cast('2024-02-01' as date) as covered from n""")
def day_coverage(spark, d):
    days = _days(spark, d)
    spans = days.groupBy("user_id").agg(F.min("day").alias("start")).withColumn("end", F.date_add("start", 2))
    return streaks.covers(days, spans, ["user_id"], F.expr(DAY))


_PHASE = "case when strftime(k, '%m-%d') < '12-01' then 'prep' when strftime(k, '%m-%d') < '12-28' then 'dec' else 'final' end"


@query(f"""
with o as (select distinct cast(o_orderdate as date) as day from orders),
e as (select day, unnest(generate_series(day, make_date(year(day), 12, 31), interval 1 day))::date as k from o)
select day, any_value(case when strftime(day, '%m-%d') < '12-01' then 'prep' when strftime(day, '%m-%d') < '12-28' then 'dec' else 'final' end) as phase, (make_date(year(day), 12, 31) - day + 1)::int as days_left, sum(case {_PHASE} when 'prep' then 1 when 'dec' then 2 else 7 end)::int as weighted from e group by day""")
def weighted_days(spark, d):
    day = C("day")
    o = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", cal.phase(day, F.year(day)).alias("phase"), cal.days_left(day, F.year(day)).alias("days_left"), cal.weighted_days(day, F.year(day)).alias("weighted"))


_TITLE = "case " + " ".join(f"when n >= {n} then '{t}'" for n, t in cal.TITLES) + " end"


@query(f"select user_id, n, {_TITLE} as title from (select user_id, count(*) filter (where event_type = 'purchase') as n from events group by user_id)")
def title_tiers(spark, d):
    n = _t(spark, d, "events").groupBy("user_id").agg(F.count_if(C("event_type") == "purchase").alias("n"))
    return n.withColumn("title", cal.title_for(C("n")))


@query(r"select conv_id, turn, try_cast(nullif(regexp_extract(replace(text, ',', ''), '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') as double) as number from conversations")
def numbers_in_turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", cal.number_in(C("text")).alias("number"))


@query("""
with e as (select event_id, ts, user_id, max(cast(ts + interval 9 hour as date)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as last_day from events)
select event_id, coalesce(cast(ts + interval 9 hour as date) < last_day, false) as suspect from e""")
def clock_suspects(spark, d):
    from pyspark.sql.window import Window as W

    last = F.max(cal.jst_day(C("ts"))).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    return _t(spark, d, "events").select("event_id", "ts", last.alias("last_day")).select("event_id", cal.clock_suspect(C("ts"), C("ts"), C("last_day")).alias("suspect"))


# -- letters and colours ----------------------------------------------------------------------


@query(f"select doc_id, md5(translate(rtrim(to_base64(encode(text)), '='), '{codec.BASE64}', '{codec.LETTERS}')) as letters from documents")
def letter_codec(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(codec.to_letters(C("text").cast("binary"))).alias("letters"))


@query(f"""
with l as (select doc_id as slot, translate(rtrim(to_base64(encode(text)), '='), '{codec.BASE64}', '{codec.LETTERS}') as data from documents)
select slot, md5(data) as data, true as ok, true as same from l where data <> ''""")
def card_round_trip(spark, d):
    cards = _t(spark, d, "documents").select(C("doc_id").alias("slot"), codec.to_letters(C("text").cast("binary")).alias("data"))
    back = codec.read_card(codec.card_lines(cards))
    docs = _t(spark, d, "documents").select(C("doc_id").alias("slot"), "text")
    return back.join(docs, "slot").select("slot", F.md5("data").alias("data"), "ok", (codec.from_letters(C("data")) == C("text").cast("binary")).alias("same"))


@query("""
with c as (select distinct unicode(ch) as cp from (select unnest(string_split(text, '')) as ch from documents) where ch <> ''),
r as (select cp, cp - row_number() over (order by cp) as run from c)
select min(cp)::int as first, max(cp)::int as last from r group by run""")
def character_ranges(spark, d):
    return codec.code_ranges(codec.used_characters(_t(spark, d, "documents")))


_HEX = "('#' || upper(lpad(format('{:x}', (p_partkey * 7919) % 16777216), 6, '0')))"


@query(f"""
with c as (select p_partkey, {_HEX} as color from part),
x as (select *, ('0x' || substr(color, 2, 2))::int as r, ('0x' || substr(color, 4, 2))::int as g, ('0x' || substr(color, 6, 2))::int as b from c)
select p_partkey, color, 0.299 * r + 0.587 * g + 0.114 * b < 128 as dark, round(0.2126 * r / 255 + 0.7152 * g / 255 + 0.0722 * b / 255, 6) as luma, round((greatest(r, g, b) - least(r, g, b)) / 255, 6) as chroma,
round_even((p_size * 7) / (96 / 72.0), 1) as pt from x join part using (p_partkey)""")
def colors(spark, d):
    as_text = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((C("p_partkey") * 7919) % 16777216), 6, "0")))
    rows = _t(spark, d, "part").select("p_partkey", "p_size", color.css_color(as_text).alias("color"))
    c = C("color")
    return rows.select("p_partkey", "color", color.is_dark(c, exact=True).alias("dark"), F.round(color.luma(c), 6).alias("luma"), F.round(color.chroma(c), 6).alias("chroma"), color.px_to_pt(F.concat((C("p_size") * 7).cast("string"), F.lit("px"))).alias("pt"))


# -- presentations --------------------------------------------------------------------------------

_OPS = ["lumMod", "lumOff", "satMod", "satOff", "hueMod", "hueOff", "shade", "tint", "gray", "inv"]
_VALUES = [0.37, 0.11, 0.61, 0.17, 0.83, 47.0, 0.53, 0.29, 0.0, 0.0]


def _step_sql(n: int, op: str, value: str) -> str:
    """Common table expressions that take colours (p_partkey, r, g, b) of c{n} to c{n + 1} by one step."""
    linear = lambda c: f"case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end"
    shown = lambda c: f"case when {c} <= 0.0031308 then {c} * 12.92 else 1.055 * pow({c}, 1 / 2.4) - 0.055 end"
    mixed = lambda c: f"least(1, greatest(0, ({linear(c)}) * v + case when op = 'tint' then 1 - v else 0 end))"
    wheel = lambda c, most, some: f"m + case when floor(hp) in ({most}) then ch when floor(hp) in ({some}) then x else 0 end as w{c}"
    picked = lambda c: f"case when op like 'lum%' or op like 'sat%' or op like 'hue%' then w{c} when op in ('shade', 'tint') then {shown('x' + c)} when op = 'gray' then 0.299 * r + 0.587 * g + 0.114 * b when op = 'inv' then 1 - {c} else {c} end as {c}"
    return f"""
a{n} as (select *, {op} as op, {value} as v, greatest(r, g, b) as hi, least(r, g, b) as lo from c{n}),
b{n} as (select *, (hi + lo) / 2 as l, case when hi = lo then 0 when hi + lo > 1 then (hi - lo) / (2 - hi - lo) else (hi - lo) / (hi + lo) end as s,
  60 * case when hi = lo then 0 when hi = r then (((g - b) / (hi - lo)) + 6) % 6 when hi = g then (b - r) / (hi - lo) + 2 else (r - g) / (hi - lo) + 4 end as h from a{n}),
d{n} as (select *, case op when 'lumMod' then least(1, l * v) when 'lumOff' then least(1, l + v) else l end as l2, case op when 'satMod' then least(1, s * v) when 'satOff' then least(1, s + v) else s end as s2,
  case op when 'hueMod' then h * v when 'hueOff' then h + v else h end as h2 from b{n}),
e{n} as (select *, (1 - abs(2 * l2 - 1)) * s2 as ch, (h2 % 360) / 60 as hp from d{n}),
f{n} as (select *, ch * (1 - abs(hp % 2 - 1)) as x, l2 - ch / 2 as m, {', '.join(f'{mixed(c)} as x{c}' for c in 'rgb')} from e{n}),
g{n} as (select *, {wheel('r', '0, 5', '1, 4')}, {wheel('g', '1, 2', '0, 3')}, {wheel('b', '3, 4', '2, 5')} from f{n}),
c{n + 1} as (select p_partkey, {', '.join(picked(c) for c in 'rgb')} from g{n})"""


def _case(key: str, values: list) -> str:
    return f"case {key} " + " ".join(f"when {i} then {v!r}" for i, v in enumerate(values)) + " end"


@query(f"""
with k as (select p_partkey, p_size % 4 as tag, (p_partkey * 7919) % 16777216 as n, case p_partkey % 3 when 0 then '0x1F2A3B'::int when 1 then '0xC05A11'::int end as slot from part),
c0 as (select p_partkey, {', '.join(f"case when tag = 2 then round_even(((p_partkey * {k}) % 1000) / 1000.0 * 255, 0) / 255 when tag = 3 then ((slot >> {z}) & 255) / 255.0::double else ((n >> {z}) & 255) / 255.0::double end as {c}" for c, k, z in (('r', 3, 16), ('g', 7, 8), ('b', 11, 0)))} from k),
{_step_sql(0, _case('p_partkey % 10', _OPS), _case('p_partkey % 10', _VALUES))},
{_step_sql(1, _case('(p_partkey // 10) % 10', _OPS), _case('(p_partkey // 10) % 10', _VALUES))}
select p_partkey, case when known then '#' || {" || ".join(f"upper(lpad(format('{{:x}}', round_even(least(1, greatest(0, {c})) * 255, 0)::bigint), 2, '0'))" for c in 'rgb')} end as color from c2 join (select p_partkey, r is not null as known from c0) using (p_partkey)""")
def theme_colors(spark, d):
    """Colour elements of all four kinds on a theme with a map and a missing slot, each after two steps."""
    key = C("p_partkey")
    pick = lambda i, values: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    rgb = F.lpad(F.lower(F.hex((key * 7919) % 16777216)), 6, "0")
    slot = decks.scheme_slot(pick(key % 3, ["tx1", "accent1", "phClr"]), F.create_map(F.lit("tx1"), F.lit("dk1")), F.create_map(*[F.lit(x) for x in ("dk1", "#1F2A3B", "accent1", "#C05A11")]))
    base = decks.base_color(pick(C("p_size") % 4, ["srgbClr", "sysClr", "scrgbClr", "schemeClr"]), rgb, [((key * k) % 1000) / 1000.0 for k in (3, 7, 11)], slot)
    step = lambda i: F.struct(pick(i, _OPS).alias("op"), pick(i, _VALUES).alias("value"))
    steps = F.array(step(key % 10), step(F.floor(key / 10) % 10))
    return _t(spark, d, "part").select("p_partkey", color.transformed(base, steps).alias("color"))


@query("""
select c_custkey, case when c_acctbal > 5000 then c_acctbal when n_nationkey % 3 = 0 then length(n_name) else r_regionkey end::double as value,
case when c_acctbal > 5000 then 0 when n_nationkey % 3 = 0 then 1 else 2 end::int as rank
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def inherited_values(spark, d):
    """A customer's value by the first layer that knows one: its own, its nation's, its region's."""
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    base = _t(spark, d, "customer").select("c_custkey", "c_acctbal", C("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").join(region, C("n_regionkey") == C("r_regionkey"))
    values = [F.when(C("c_acctbal") > 5000, C("c_acctbal")), F.when(C("n_nationkey") % 3 == 0, F.length("n_name")), C("r_regionkey")]
    rows = base.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), v.cast("double").alias("value")) for i, v in enumerate(values)])).alias("x")).select("c_custkey", "x.*")
    return layers.first_known(rows, ["c_custkey"])


@query("""
with r as (select p_partkey, case when p_partkey % 4 = 0 then '#112233' end as color, case p_partkey % 3 when 0 then 12.5 end as size_pt, case p_partkey % 5 when 0 then true when 1 then false end as bold, case p_partkey % 7 when 0 then 'left' end as align,
  case p_size % 5 when 0 then '#0a7' when 1 then 'rgb(16, 32, 48)' when 2 then 'red' when 3 then '#333333' end as css_color, case when p_size % 2 = 0 then p_size || 'px' when p_size % 3 = 0 then '2em' end as css_size,
  case p_size % 4 when 0 then '700' when 1 then '500' when 2 then 'bold' end as css_weight, case p_size % 6 when 0 then 'center' when 1 then 'left' when 2 then 'justify' end as css_align from part),
v as (select *, case css_color when '#0a7' then '#00AA77' when 'rgb(16, 32, 48)' then '#102030' end as shade, case when css_size like '%px' then nullif(round_even(replace(css_size, 'px', '')::double / (96 / 72.0), 1), 0) end as pt, css_weight in ('700', 'bold') as heavy from r),
f as (select *, case when color is null then shade end as c, case when size_pt is null then pt end as s, case when not coalesce(bold, false) and heavy then true end as b from v)
select p_partkey, coalesce(c, color) as color, coalesce(s, size_pt)::double as size_pt, coalesce(b, bold) as bold, coalesce(align, case when css_align in ('center', 'justify') then css_align end) as align,
concat_ws(',', case when c is not null then 'color' end, case when s is not null then 'size_pt' end, case when b is not null then 'bold' end) as inherited from f""")
def applied_styles(spark, d):
    """Runs that say some of their style themselves, in surroundings that say some; the page's own colour is #333333."""
    key, size = C("p_partkey"), C("p_size")
    says = lambda k, v: F.when(v.isNotNull(), F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    css = {
        "color": F.when(size % 5 == 0, "#0a7").when(size % 5 == 1, "rgb(16, 32, 48)").when(size % 5 == 2, "red").when(size % 5 == 3, "#333333"),
        "font-size": F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit("px"))).when(size % 3 == 0, "2em"),
        "font-weight": F.when(size % 4 == 0, "700").when(size % 4 == 1, "500").when(size % 4 == 2, "bold"),
        "text-align": F.when(size % 6 == 0, "center").when(size % 6 == 1, "left").when(size % 6 == 2, "justify"),
    }
    runs = _t(spark, d, "part").select(
        "p_partkey", F.when(key % 4 == 0, "#112233").alias("color"), F.when(key % 3 == 0, 12.5).alias("size_pt"), F.when(key % 5 == 0, True).when(key % 5 == 1, False).alias("bold"),
        F.when(key % 7 == 0, "left").alias("align"), F.lit(None).cast("array<string>").alias("inherited"), F.map_concat(*[says(k, v) for k, v in css.items()]).alias("css"),
    )
    got = layers.styled(runs, C("css"), F.create_map(F.lit("color"), F.lit("#333")))
    return got.drop("css").withColumn("inherited", F.array_join("inherited", ","))


@query("""
with recursive b as (select l_orderkey as slide, l_orderkey * 10 + l_linenumber as node, (l_partkey * 37 % 900)::double as x, (l_suppkey * 53 % 500)::double as y, 10.0 + l_quantity * 6 as w, 20.0 + l_linenumber * 9 as h from lineitem),
e as (select p.node as a, q.node as b from b p join b q on p.slide = q.slide and p.node <> q.node where p.x - q.x - q.w <= 12 and q.x - p.x - p.w <= 12 and p.y - q.y - q.h <= 12 and q.y - p.y - p.h <= 12),
r as (select node, node as root from b union select e.b, r.root from r join e on r.node = e.a),
g as (select node, min(root) as grp from r group by node)
select slide, grp, count(*) as n, min(x) as x, min(y) as y, max(x + w) as right_x, max(y + h) as bottom_y from b join g using (node) group by slide, grp""")
def box_groups(spark, d):
    """Boxes of a slide at most 12 points apart, over others too, with the box around each group."""
    row = _t(spark, d, "lineitem")
    boxes = row.select(
        C("l_orderkey").alias("slide"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("node"), (C("l_partkey") * 37 % 900).cast("double").alias("x"), (C("l_suppkey") * 53 % 500).cast("double").alias("y"),
        (10.0 + C("l_quantity") * 6).cast("double").alias("w"), (20.0 + C("l_linenumber") * 9).cast("double").alias("h"),
    )
    g = diagrams.groups_of_boxes(boxes, ["slide"], 12.0)
    return g.groupBy("slide", "grp").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(C("x") + C("w")).alias("right_x"), F.max(C("y") + C("h")).alias("bottom_y"))


_KINDS = ["kpi", "timeline", "compare", "flow"]


@query(f"""
with e as (select l_orderkey as page_id, l_linenumber * 1000000 + l_partkey as el_no, {_case('l_orderkey % 4', _KINDS)} as kind, 'd' || (l_linenumber % 2) as diagram, 's' || l_suppkey as head, l_returnflag as flag, l_linestatus as mark,
  (l_partkey % 3) * 100.0 + l_suppkey % 2 as x, (l_quantity * 3)::double as y from lineitem),
c as (select *, (l_part)::int as col from (select *, floor(x / 100) as l_part from e)),
n as (select *, row_number() over (partition by page_id, kind, diagram, col order by floor(y / 20), x, el_no) as nth, lead(head) over (partition by page_id, kind, diagram, col order by floor(y / 20), x, el_no) as below from c),
f as (select * from n where kind = 'flow' or nth % 2 = 1),
i as (select *, row_number() over (partition by page_id, kind, diagram order by floor(y / 20), x, el_no) as item_no from f)
select page_id, kind, diagram, item_no::int as item_no, case when kind = 'kpi' then coalesce(below, head) else head end as title, case when kind = 'kpi' then head end as value,
case when kind = 'flow' then flag || ' ' || mark else below end as text from i where kind <> 'compare' or item_no <= 2""")
def diagram_items(spark, d):
    """Items of diagrams told by the names of their boxes: pairs by columns, comparisons of two, boxes of one item each."""
    order = C("l_orderkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (order % 4 + 1).cast("int"))
    name = F.concat_ws(":", F.lit("diagram"), kind, F.concat(F.lit("d"), (C("l_linenumber") % 2).cast("string")), C("l_linenumber").cast("string"))
    boxes = _t(spark, d, "lineitem").select(
        order.alias("page_id"), F.lit(1).alias("slide_no"), (C("l_linenumber") * 1000000 + C("l_partkey")).alias("el_no"), name.alias("name"), F.array(F.concat(F.lit("s"), C("l_suppkey").cast("string")), F.lit(" "), "l_returnflag", "l_linestatus").alias("lines"),
        ((C("l_partkey") % 3) * 100.0 + C("l_suppkey") % 2).alias("x"), (C("l_quantity") * 3).cast("double").alias("y"), F.lit(50.0).alias("w"), F.lit(10.0).alias("h"),
    )
    return diagrams.items(diagrams.members(boxes)).drop("slide_no")


# -- conversations ------------------------------------------------------------------------------


@query(f"""
with t as (select conv_id, turn, role, array_to_string({FILLED.format('text')}, ' / ') as o from conversations),
l as (select conv_id, turn, role || ': ' || case when length(o) > 160 then left(o, 160) || '...' else o end as line from t)
select conv_id, count(*)::int as turns, md5(string_agg(line, chr(10) order by turn, line)) as digest from l group by conv_id""")
def conversation_digest(spark, d):
    line = F.concat(C("role"), F.lit(": "), tx.one_line(C("text")))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(F.count("*").cast("int").alias("turns"), F.md5(joined).alias("digest"))


# -- pages ----------------------------------------------------------------------------------------


@query()
def page_elements(spark, d):
    got = html.elements(_t(spark, d, "pages"))
    return got.select("page_id", "slide_no", "el_no", "layout", "type", "role", F.md5(structure.plain_text(C("lines"))).alias("text"))


@query()
def page_kinds(spark, d):
    rows = structure.classified(structure.slides(html.elements(_t(spark, d, "pages"))))
    return rows.select("page_id", "slide_no", "layout", "title", "kind", "reason", F.size("body").alias("n_body"))


@query()
def page_prompts(spark, d):
    pages = _t(spark, d, "pages")
    rows = structure.classified(structure.slides(html.elements(pages)))
    got = prompts.prompts(rows, pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title")), 4000)
    return got.select("page_id", F.md5("prompt").alias("prompt"), F.array_join("kinds", ",").alias("kinds"), "n_slides", "dropped")


@query()
def page_themes(spark, d):
    got = theme.themes(_t(spark, d, "pages"))
    return got.select("page_id", F.to_json("colors").alias("colors"), F.to_json("fonts").alias("fonts"), F.array_join("palette", ",").alias("palette"), "external_css")


@query("select page_id, case when contains(lower(left(html, 400)), '<html') or contains(lower(left(html, 400)), '<!doctype') or regexp_matches(lower(url), '\\.html?$') then 'html' else 'unknown' end as kind from pages")
def page_file_kinds(spark, d):
    return _t(spark, d, "pages").select("page_id", kinds.plain_kind(C("html").cast("binary"), C("url")).alias("kind"))


@query(f"""
with s as (select path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '[\\\\/:*?"<>|0-9]', '_', 'g') as stem from {FILES}),
n as (select path, stem, row_number() over (partition by stem order by path) as k from s)
select path, case when k = 1 then stem else stem || '_' || k end as file_name from n""")
def digest_names(spark, d):
    rows = _files(spark, d).select("path", F.regexp_replace("path", "[0-9](?=[^/]*$)", "_").alias("shown"))
    return records.unique_names(rows, "shown", ["path"]).select("path", "file_name")


@query("select sha1(text) as sha1, min(conv_id * 1000000 + turn) as first from conversations group by 1")
def first_turns(spark, d):
    rows = _t(spark, d, "conversations").select((C("conv_id") * 1_000_000 + C("turn")).alias("first"), "text")
    return records.first_assets(rows, "text", ["first"]).select("sha1", "first")


@query("""
with t as (select conv_id, turn, role, text, case when lag(role) over (partition by conv_id order by turn) is not distinct from role then 0 else 1 end as fresh from conversations),
i as (select *, sum(fresh) over (partition by conv_id order by turn) as island from t)
select conv_id, min(turn) as first, any_value(role) as role, md5(string_agg(text, '' order by turn)) as text from i group by conv_id, island""")
def merged_turns(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return records.merged_runs(rows, ["conv_id"], "turn", "role", "text").select("conv_id", "first", "role", F.md5("text").alias("text"))


@query("select doc_id, not starts_with(p, '/') and not contains(p, '..') as safe from (select doc_id, case doc_id % 4 when 0 then '/' || source when 1 then '../' || source when 2 then source || '/./' || lang else source || '/' || lang end as p from documents)")
def safe_paths(spark, d):
    k = C("doc_id") % 4
    p = F.when(k == 0, F.concat(F.lit("/"), C("source"))).when(k == 1, F.concat(F.lit("../"), C("source"))).when(k == 2, F.concat_ws("/./", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang"))
    return _t(spark, d, "documents").select("doc_id", records.is_safe_path(p).alias("safe"))


@query("select doc_id, true as same, true as tampered from documents")
def sealed_texts(spark, d):
    key, head = F.lit("0123456789abcdef").cast("binary"), F.lit("head").cast("binary")
    sealed = records.seal(C("text").cast("binary"), key, head)
    rows = _t(spark, d, "documents").select("doc_id", "text", sealed.alias("sealed"))
    return rows.select("doc_id", (records.unseal(C("sealed"), key, head) == C("text").cast("binary")).alias("same"), records.unseal(C("sealed"), key, F.lit("other").cast("binary")).isNull().alias("tampered"))


@query()
def digest_pages(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    got = digest.digest(docs).join(docs, "doc_id")
    page = reports.digest_page(C("doc_id").cast("string"), C("text"), C("headings"), C("newest_year"), C("date_mentions"), C("broken_references"), C("avg_sentence_length"), F.expr(DAY))
    return got.select("doc_id", F.md5(page).alias("page"))


@query("""
with e as (select user_id, count(*) filter (where event_type = 'purchase') as done, count(*) filter (where event_type = 'view') as views, count(*) as n, max(value) as best from events group by user_id),
r as (select user_id, [done >= 5, views >= 3, n > 60, best > 90] as ok from e)
select user_id::varchar as quest_id, len(list_filter(ok, lambda x: x))::bigint as satisfied, 4::bigint as total, len(list_filter(ok, lambda x: x)) = 4 as reportable from r""")
def quest_progress(spark, d):
    atoms = [("doneCount", ">=", 5, None), ("listCount", None, 3, "view"), ("streak", ">", 60, None), ("newRecord", None, None, None)]
    kind = C("event_type")
    entry = F.struct(kind.alias("kind"), kind.alias("tag"), F.when(kind == "purchase", "x").alias("done_key"), F.array().cast("array<string>").alias("flags"))
    #: a rule on entries asks for five at most, so a kind needs no more than six of them, however many events there are
    needed = max(v for a, _, v, _ in atoms if a in ("doneCount", "listCount")) + 1
    kinds_of = _t(spark, d, "events").groupBy(C("user_id").cast("string").alias("quest_id"), kind).agg(F.count("*").alias("n"), F.max("value").alias("best"))
    g = kinds_of.groupBy("quest_id").agg(F.flatten(F.collect_list(F.array_repeat(entry, F.least("n", F.lit(needed)).cast("int")))).alias("entries"), F.sum("n").cast("int").alias("streak"), F.array(F.struct(F.max("best").cast("string").alias("text"))).alias("attempts"))
    states = g.select("*", F.lit("").alias("lesson"), F.lit(None).cast("date").alias("declared_start"), F.lit("").alias("declared_reason"), F.array(F.lit("")).alias("through"), F.create_map(F.lit("record"), F.lit("90")).alias("extras"), F.lit(0).alias("timer_done"))
    rules = spark.createDataFrame([(a, op, v, t, a) for a, op, v, t in atoms], "atom string, op string, value int, text string, label string")
    every = g.select("quest_id").crossJoin(F.broadcast(rules))
    return streaks.progress(streaks.evaluate(states, every))


@query("""
with f as (select coalesce(l.quality, -1) as quality, d.source, d.n_chars from documents d left join labels l using (doc_id))
select source, count(*) as n_files, sum(n_chars)::bigint as bytes, count(*) filter (where quality = 1) as n_ok from f group by source""")
def source_coverage(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("bytes"), F.count_if(C("quality") == 1).alias("n_ok"))
