"""Text, pages, chunks and gold questions from ``documents``, ``pages`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import arrays, text
from vellum.operators import chunking, corpus, goldset, relations, sampling, setjoin
from vellum.plans.registry import query
from vellum.storage import read_table, spread

STOP = ["the", "and", "with", "for", "that"]
RULES = {"dosage": ["ation", "ment"], "use": ["tion"], "risk": ["ness", "ous"]}
TEMPLATES = {
    "dosage": ["how much of {}?", "dose of {}", "how often {}?"],
    "use": ["what is {} for?", "use of {}"],
    "risk": ["is {} safe?", "risks of {}"],
    "other": ["tell me about {}"],
}
LABEL = "substr(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^A-Za-z ]', '', 'g'), 1, 30)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


@query(
    """select doc_id, length(regexp_replace(text, '[^A-Z]', '', 'g'))::double as upper,
       md5(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) as squeezed,
       case when length(text) <= 60 then text when length(regexp_replace(substr(text, 1, 60), '\\s+\\S*$', '')) >= 24
            then rtrim(regexp_replace(substr(text, 1, 60), '\\s+\\S*$', ''), ' ') else rtrim(substr(text, 1, 60), ' ') end as short,
       sha256(trim(text, ' \t\n\r' || chr(11) || chr(12))) as query_hash,
       len(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+')) as n_tokens
       from documents"""
)
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squeezed text, cut label, hash, tokens and capitals of documents."""
    t = F.col("text")
    squeezed = F.trim(F.regexp_replace(t, r"[ \t\n\r\x0b\x0c]+", " "))
    return _docs(spark, sf_dir).select(
        "doc_id", F.regexp_count(t, F.lit("[A-Z]")).cast("double").alias("upper"), F.md5(squeezed).alias("squeezed"),
        text.cut_at_word(t, 60).alias("short"), text.query_hash(t).alias("query_hash"), F.size(text.tokens(t)).cast("long").alias("n_tokens"),
    )


@query(
    """with t as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+'),
         lambda x: length(x) >= 3 and not list_contains(['the', 'and', 'with', 'for', 'that'], x))) as ts from documents)
    select doc_id, len(ts) as n, coalesce(md5(array_to_string(list_sort(ts), ' ')), md5('')) as digest from t"""
)
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct content tokens of each document."""
    out = _docs(spark, sf_dir).select("doc_id", text.content_tokens(F.col("text"), STOP).alias("ts"))
    return out.select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ")).alias("digest"))


@query(
    """with f as (select doc_id, trim(regexp_replace(replace(regexp_replace(text, '(?m)^[ \\t\\r\\x0b\\x0c]*\\|[|: \\t\\r\\x0b\\x0c]*-[-|: ]*$', ' ', 'g'), '|', ' '),
        '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) as flat from documents),
    h as (select doc_id, flat, substr(flat, 1, 119) as head, substr(flat, 120, 1) = ' ' as whole from f)
    select doc_id, case when length(flat) <= 120 then flat else
      rtrim(case when whole or not contains(head, ' ') or regexp_replace(head, ' [^ ]*$', '') = '' then head else regexp_replace(head, ' [^ ]*$', '') end, ' ') || '…' end as snippet from h"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview line of each document."""
    return _docs(spark, sf_dir).select("doc_id", text.snippet(F.col("text"), 120).alias("snippet"))


@query(
    """select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[ \\t\\x0b\\x0c\\x{85}\\x{a0}\\x{3000}]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g')) as clean,
      md5(translate(strip_accents(text), 'đĐÐ', 'dDD')) as folded,
      trim(regexp_replace(lower(translate(strip_accents(substr(text, 1, 80)), 'đĐÐ', 'dDD')), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents"""
)
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of cleaned and of accent-folded texts, and slugs."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.md5(text.clean_lines(t)).alias("clean"), F.md5(text.fold_accents(t)).alias("folded"), text.slug(F.substring(t, 1, 80)).alias("slug")
    )


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)
    select doc_id, count(*) as n, max(length(line)) as longest, count(*) filter (where trim(line) = '') as blank from l group by doc_id"""
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents."""
    lines = corpus.lines_of(_docs(spark, sf_dir), "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("line")).alias("longest"), F.count_if(F.trim("line") == "").alias("blank"))


@query(
    """with n as (select source, doc_id, md5(lower(trim(regexp_replace(text, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')))) as d from documents)
    select source, min(doc_id) as first_id, count(*) as n from n group by source, d having count(*) > 1"""
)
def duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of one source that differ in case and spaces only."""
    return corpus.same_texts(_docs(spark, sf_dir), "doc_id", "source").select("source", "first_id", "n")


@query(
    """select lang, count(*) as n, count(distinct text) as n_texts, sum(length(text))::bigint as chars, min(length(text)) as shortest,
       max(length(text)) as longest, count(*) filter (where text = '') as empty from documents group by lang"""
)
def doc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct texts and lengths by language."""
    return corpus.corpus_audit(_docs(spark, sf_dir), "doc_id", "lang")


_OVERLAP = """
with t as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+'),
     lambda x: length(x) >= 3 and not list_contains(['the', 'and', 'with', 'for', 'that'], x))) as ts from documents),
b as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '\\p{L}+|\\p{N}+'),
     lambda x: length(x) >= 3 and not list_contains(['the', 'and', 'with', 'for', 'that'], x))) as ts from benchmark),
s as (select item_id, len(b.ts) as n, doc_id, len(list_intersect(b.ts, t.ts)) as shared from b, t),
r as (select *, row_number() over (partition by item_id order by shared desc, doc_id) as k, lead(shared, 1, 0) over (partition by item_id order by shared desc, doc_id) as second from s where shared > 0)
"""


@query(
    _OVERLAP
    + """select item_id, case when shared >= 8 and shared / n >= 0.35 and (shared / n >= 0.55 or shared - second >= 4) then doc_id end as matched,
    shared, round(shared / n, 6) as confidence from r where k = 1"""
)
def token_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that shares most tokens with each benchmark item, if it is a match."""
    docs = _docs(spark, sf_dir).select("doc_id", text.content_tokens(F.col("text"), STOP).alias("tokens"))
    items = read_table(spark, sf_dir, "benchmark").select("item_id", text.content_tokens(F.col("text"), STOP).alias("tokens"))
    out = setjoin.best_overlaps(items, docs, "item_id", "doc_id")
    return out.filter("shared is not null").select("item_id", "matched", "shared", F.round("confidence", 6).alias("confidence"))


#: Terms with other names; several begin or end at one place of a text.
_TERMS = {
    "there": ["thereon", "therein"], "station": ["tion"], "shore": ["sher", "heron"], "the": ["les"], "on the": [],
    "of": ["of the"], "of the": [], "on": [], "the and": [], "la": ["die"], "en la": ["in die"],
}


def _glossary(spark: SparkSession) -> DataFrame:
    rows = [(t, a, False, [f"{t} place"]) for t, a in _TERMS.items()]
    return spark.createDataFrame(rows, "term string, aliases array<string>, case_sensitive boolean, expansions array<string>")


#: Each word of the documents, and each two with one character between, with its place.
_NAMES = """docs as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]') as a from documents),
    atoms as (select doc_id, unnest(a) as w, unnest(range(1, len(a) + 1)) as i from docs),
    placed as (select doc_id, w, w || lead(w) over p || lead(w, 2) over p as two, sum(length(w)) over p - length(w) as place
               from atoms window p as (partition by doc_id order by i)),
    names as (select doc_id, place, unnest([w, two]) as name from placed where regexp_matches(w, '[\\p{L}\\p{N}]')),
"""


@query(
    "with " + _NAMES + "v(term, name) as (values " + ", ".join(f"('{t}', '{n}')" for t, a in _TERMS.items() for n in (t, *a)) + """),
    f as (select doc_id, term, min(place)::int as place from names join v using (name) group by all)
    select doc_id, term, place, term || ' = ' || term || ' place' as meaning from f
    qualify row_number() over (partition by doc_id order by place, term) <= 8"""
)
def term_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms of each document by first place, each found by itself."""
    return chunking.detected_terms(_docs(spark, sf_dir), "doc_id", _glossary(spark))


_ATOM = r"([\p{L}\p{N}]+|[^\p{L}\p{N}])"


@query(
    "with " + _NAMES + """items as (select distinct regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]') as a from benchmark),
    each as (select a, unnest(range(1, len(a) + 1)) as i from items),
    v as (select distinct name from (select a[i] as name from each union all select a[i] || a[i + 1] || a[i + 2] from each where a[i + 1] = ' ' and i + 2 <= len(a))
          where regexp_full_match(name, '[\\p{L}\\p{N}]+( [\\p{L}\\p{N}]+)?')),
    f as (select doc_id, name as term, min(place)::bigint as place from names join v using (name) group by all)
    select doc_id, term, place from f qualify row_number() over (partition by doc_id order by place, term) <= 8"""
)
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first terms of each document of a glossary that is all words and neighbours of the benchmark."""
    atoms = read_table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(_ATOM), 1).alias("a"))
    names = F.concat("a", F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: F.array_join(F.slice("a", i, 3), "")))
    words = atoms.filter(F.size("a") > 0).select(F.explode(names).alias("term")).distinct()
    glossary = words.filter(F.col("term").rlike(r"^[\p{L}\p{N}]+( [\p{L}\p{N}]+)?$")).select(
        "term", F.lit(None).cast("array<string>").alias("aliases"), F.lit(False).alias("case_sensitive"), F.array().cast("array<string>").alias("expansions")
    )
    out = chunking.detected_terms(_docs(spark, sf_dir), "doc_id", glossary)
    return out.select("doc_id", "term", F.col("place").cast("long").alias("place"))


@query(
    """with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
    g as (select doc_id, unnest(range(1, len(w) + 1)) as i, w from w),
    n as (select doc_id, i, unnest([w[i], array_to_string(w[i:i+1], ' '), array_to_string(w[i:i+2], ' ')]) as name from g),
    v as (select * from (values ('a', 'the'), ('a', 'with the'), ('b', 'and'), ('c', 'there'), ('d', 'this is the')) as v(term, name)),
    f as (select doc_id, term, min(i) as place from n join v using (name) group by all)
    select doc_id, term, place from f qualify row_number() over (partition by doc_id order by place, term) <= 8"""
)
def glossary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary names of up to three words, met by an equi-join on word runs."""
    glossary = spark.createDataFrame([("a", "the"), ("a", "with the"), ("b", "and"), ("c", "there"), ("d", "this is the")], "term string, name string")
    out = chunking.glossary_matches(_docs(spark, sf_dir), "doc_id", glossary)
    return out.select("doc_id", "term", "place")


@query()
def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of one prose block, in chunks with content-addressed ids."""
    block = F.struct(
        F.lit("prose").alias("kind"), F.col("text").alias("markdown"), F.lit(None).cast("int").alias("start_page"),
        F.lit(None).cast("int").alias("end_page"), F.lit(None).cast("string").alias("table_key"),
    )
    sections = _docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), "doc_id").alias("section_key"), F.col("source").alias("title"), F.col("lang").alias("heading"),
        F.array(F.col("lang")).alias("context_path"), F.array(F.col("source")).alias("aliases"),
        F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.array(block).alias("blocks"),
    )
    out = chunking.chunk_sections(sections, _glossary(spark), 1000)
    return out.select("chunk_id", "section_key", "ordinal", F.length("chunk_text").alias("chars"), "embedding_sha256", F.size("terms").alias("n_terms"))


@query(
    """with u as (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc-' || doc_id)) as d from documents)
    select doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
      substr('89ab', (('0x' || substr(d, 17, 1))::int % 4) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) as id from u"""
)
def document_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs in the JVM."""
    import uuid

    name = F.concat(F.lit("doc-"), "doc_id")
    return _docs(spark, sf_dir).select("doc_id", arrays.name_uuid(name, uuid.NAMESPACE_URL).alias("id"))


# -- pages ----------------------------------------------------------------------------------------
@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown, title and size of each page.  Tested on written pages."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", corpus.page_title(F.col("html")).alias("title"), corpus.html_markdown(F.col("html")).alias("markdown")
    )


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the pages' markdown."""
    md = page_markdown(spark, sf_dir).select("page_id", F.col("markdown").alias("text"))
    return corpus.markdown_sections(md, "page_id")


@query(
    """select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)/[^/?#]+/?$', 1) as kind from pages
       where regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)/[^/?#]+/?$', 1) in ('en', 'fr', 'es')"""
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the category in their address."""
    kind = corpus.page_kind(F.col("url"), ["en", "fr", "es"])
    return read_table(spark, sf_dir, "pages").select("page_id", kind.alias("kind")).filter("kind is not null")


# -- gold questions -------------------------------------------------------------------------------
_QUESTIONS = (
    "with s as (select doc_id as section_id, trim(" + LABEL + ") as label, lower(text) as t from documents), "
    """c as (select section_id, label, case when contains(t, 'ation') or contains(t, 'ment') then 'dosage' when contains(t, 'tion') then 'use'
       when contains(t, 'ness') or contains(t, 'ous') then 'risk' else 'other' end as category from s),
    v as (select c.*, unnest(range(3)) as variant from c),
    tp as (select * from (values ('dosage', ['how much of {}?', 'dose of {}', 'how often {}?']), ('use', ['what is {} for?', 'use of {}']),
       ('risk', ['is {} safe?', 'risks of {}']), ('other', ['tell me about {}'])) as t(category, ts)),
    q as (select section_id, v.category, variant, replace(ts[variant % len(ts) + 1], '{}', label) as query from v join tp using (category)),
    u as (select * from q qualify row_number() over (partition by query order by section_id, variant) = 1)
    """
)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "[^A-Za-z ]", "")
    sections = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("section_id"), F.trim(F.substring(plain, 1, 30)).alias("label"),
        goldset.category_of(F.col("text"), RULES, "other").alias("category"),
    )
    return goldset.unique_questions(goldset.questions(sections, TEMPLATES, 3), ("section_id", "variant"))


@query(_QUESTIONS + "select section_id, category, variant, query from u")
def gold_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from templates by category; each text once, its first section's."""
    return _questions(spark, sf_dir).select("section_id", "category", F.col("variant").cast("long").alias("variant"), "query")


@query(
    _QUESTIONS
    + """, r as (select *, row_number() over (partition by category order by section_id, variant) as turn from u),
    k as (select * from r where turn <= case category when 'dosage' then 30 when 'use' then 20 when 'risk' then 10 else 5 end)
    select printf('q-%05d', row_number() over (order by turn, category)) as query_id, section_id, category from k"""
)
def gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered gold set with a target per category, categories in turn."""
    out = goldset.gold_rows(_questions(spark, sf_dir), {"dosage": 30, "use": 20, "risk": 10, "other": 5})
    return out.select("query_id", "section_id", "category")


_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}\\x{E000}-\\x{F8FF}\\x{FFFD}]"


@query(
    f"""with t as (select doc_id, regexp_extract(coalesce(text, ''), '{_CONTROL}') as own, regexp_extract(replace(text, 'er', chr(7)), '{_CONTROL}') as bell from documents)
    select doc_id, case when own <> '' then 'U+' || printf('%04X', unicode(own)) end as own, case when bell <> '' then 'U+' || printf('%04X', unicode(bell)) end as bell from t"""
)
def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first character of each text that clean text hasn't, as it is and with bells for a syllable."""
    found = arrays.printable_problem
    return _docs(spark, sf_dir).select("doc_id", found(F.col("text")).alias("own"), found(F.replace("text", F.lit("er"), F.lit("\x07"))).alias("bell"))


@query(
    r"""select item_id, regexp_replace(regexp_replace(strip_accents(text), '(?i)\bthe\b', 't', 'g'), '(?i)\bque\b', 'q', 'g') as typed from benchmark"""
)
def careless_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as somebody in a hurry types them."""
    items = read_table(spark, sf_dir, "benchmark")
    return items.select("item_id", text.typed_carelessly(F.col("text"), {"the": "t", "que": "q"}).alias("typed"))


@query(
    """select doc_id, unnest([7, 8, 12])::bigint as number, unnest([doc_id || chr(10) || 'more [3] of it', source, 'x ' || lang]) as block from documents"""
)
def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a context by number, the last of equal numbers."""
    whole = F.concat(
        F.lit("before\n[7] gone\n[8] "), F.coalesce("source", F.lit("")), F.lit("\n[12]  x "), F.col("lang"), F.lit(" \n\n[7] "), F.col("doc_id"), F.lit("\nmore [3] of it\n")
    )
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(text.context_blocks(whole)).alias("number", "block"))


@query(
    """with w as (select source, count(*) as w from documents where source is not null group by source), s as (select sum(w) as s from w),
    b as (select source, 1000 * w // s as base, 1000 * w % s as rest from w, s)
    select source, (base + case when row_number() over (order by rest desc, source) <= 1000 - sum(base) over () then 1 else 0 end)::bigint as quota from b"""
)
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand places dealt to the sources in proportion to their documents."""
    counts = read_table(spark, sf_dir, "documents").filter("source is not null").groupBy("source").count()
    dealt = sampling.weighted_targets({r["source"]: r["count"] for r in counts.collect()}, 1000)  # a number per source
    return spark.createDataFrame(sorted(dealt.items()), "source string, quota long")


@query(
    """select doc_id, case when n_chars % 2 = 0 then coalesce(source, '') || chr(10) || '> ' || lang || chr(10) || '> Part 2' else coalesce(source, '') || ' > ' || lang end as header from documents where source <> ''"""
)
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines of chunks: title and path without label lines, or title and heading where there is no path."""
    docs = read_table(spark, sf_dir, "documents").filter("source <> ''")
    path = F.when(F.col("n_chars") % 2 == 0, F.array(F.col("lang"), F.lit(""), F.lit("Part 2\nKnown as: x"))).otherwise(F.array(F.lit("")))
    long = chunking.context_header(F.col("source"), path, F.col("lang"), ["Known as"])
    hidden = chunking.context_header(F.concat(F.lit("Known as: "), F.col("source")), F.array(F.lit("")), F.col("lang"), ["Known as"])
    short = F.regexp_replace(hidden, "^Known as: ", "")
    return docs.select("doc_id", F.when(F.col("n_chars") % 2 == 0, long).otherwise(short).alias("header"))
