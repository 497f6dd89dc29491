"""Licence scan by a positional index of rare words, with DataFrame functions only.

Templates are runs of words with mandatory key phrases. One pass over the texts
notes where licence words (words of any template) stand. Their document counts
over all rows rank them: the fewer documents have a word, the rarer. For every
file and template the ANCHORS rarest words of the template that the file has are
looked up in the template's postings; a word at i that the template has at q
proposes the start i - q, and the proposals meet by start. A start that at least
half of the anchors propose is a candidate. It stands if all words of the
template's key phrases are at their places; its share is that of all words of the
template at their places.

The base phrases are templates that consist of one key phrase; their places are
the ones found so. Other templates add labels of their own. ``score`` is the
largest share of a template found, base phrases counting half: they may be a mere
mention. A file with no words of some key phrase is looked up for no template with
it; nothing is found there.

Results: a row for every row of the table, those without a doc_id and repeated ones
too. Null and empty texts have no words, no labels ('') and score 0. Texts are
looked at in pieces of PIECE bytes, of which a row keeps only counts and
licence words, so a long text needs no array of all its words; words across two
pieces belong to the first. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.llm.scratch import Scratch, documents

#: What separates words, in texts as they are; A-Z are letters that are compared in lower case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text that are looked at together, and most bytes of a word that matter (licence words have fewer).
PIECE, WORD = 1 << 16, 64
#: Rarest words of a template that are looked up.
ANCHORS = 4
#: Share of a base phrase in the score.
MENTION = 0.5

#: (label, words, key phrases), fixed values. The first three are the base phrases.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = tuple((label, phrase, (phrase,)) for label, phrase in BASE) + (
    ("mit-grant", "released under the mit license", ("under the mit license",)),
    ("mit-grant", "licensed under the mit license", ("under the mit license",)),
    ("mit-terms", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("the apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-header", "under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc-terms", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0-1.0", "released under cc0 1 0", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)


def _mandatory(phrase: str, keys: tuple[str, ...]) -> set[int]:
    """Places of the template that its key phrases cover."""
    words, found = phrase.split(), set()
    for key in keys:
        part = key.split()
        starts = [i for i in range(len(words)) if words[i : i + len(part)] == part]
        found |= {i + k for i in starts for k in range(len(part))}
    return found


#: (template, place, word, mandatory) of every word of every template.
POSTINGS = [(t, q, word, q in _mandatory(phrase, keys)) for t, (_, phrase, keys) in enumerate(TEMPLATES) for q, word in enumerate(phrase.split())]
_VALUES = ", ".join(f"({t}, {q}, '{word}', {str(must).lower()})" for t, q, word, must in POSTINGS)
VOCABULARY = sorted({word for _, _, word, _ in POSTINGS})


def _word_list(text: Column) -> Column:
    """The words of a text, as they are written."""
    return F.filter(F.split(text, f"{GAP}+"), lambda x: x != "")


def _piece(data: Column, k: Column) -> Column:
    """The words that begin in piece ``k`` of the UTF-8 bytes, as a text. Bytes of other characters than ASCII are letters, so a cut between them is one inside a word."""
    start = k * PIECE
    part = lambda at, size: F.substr(data, at, F.lit(size)).cast("string")
    inside = part(start, 1).rlike(LETTER) & (k > 0)  # its first word began in the piece before
    goes_on = part(start + PIECE, 1).rlike(LETTER)
    whole = F.concat(part(start + 1, PIECE), F.when(goes_on, F.regexp_extract(part(start + PIECE + 1, WORD), f"^{LETTER}*", 0)).otherwise(""))
    return F.when(inside, F.regexp_replace(whole, f"^{LETTER}+", "")).otherwise(whole)


def _noted(words: Column) -> Column:
    """The number of words, and (at, word) of licence words."""
    maybe = F.array_compact(F.transform(words, lambda x, i: F.when(F.lower(x).isin(VOCABULARY), i)))
    hits = F.transform(maybe, lambda i: F.struct(i.cast("long").alias("at"), F.translate(F.get(words, i), UPPER, LOWER).alias("word")))
    return F.struct(F.size(words).cast("long").alias("n"), hits.alias("hits"))


def _joined(pieces: Column) -> Column:
    """Counts and licence words of all pieces, places counted from the text's start."""
    # Each piece's words come after those of the pieces before it.
    starts = F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["n"])))

    def moved(starts: Column) -> Column:
        hits = F.transform(pieces, lambda p, k: F.transform(p["hits"], lambda h: F.struct((h["at"] + F.get(starts, k)).alias("at"), h["word"].alias("word"))))
        return F.struct(F.element_at(starts, -1).alias("n_words"), F.flatten(hits).alias("hits"))

    return F.transform(F.array(starts), moved)[0]


def _possible(present: Column) -> Column:
    """Whether the file has all words of some template's key phrases."""
    needs = {tuple(sorted({word for t, _, word, must in POSTINGS if must and t == number})) for number in range(len(TEMPLATES))}
    tests = [F.size(F.array_intersect(present, F.array(*map(F.lit, words)))) == len(words) for words in sorted(needs)]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def noted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, row (a number of its own), n_words, present (licence words of the file), hits (at, word; only where a template is possible)."""
    last = F.floor(F.greatest(F.octet_length("__data") - 1, F.lit(0)) / PIECE).cast("int")
    pieces = lambda data: F.transform(F.sequence(F.lit(0), last), lambda k: F.transform(F.array(_word_list(_piece(data, k))), _noted)[0])
    cut = F.transform(F.array("__data"), pieces)[0]  # bytes are taken out of the row once
    rows = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__data")).select(id, F.monotonically_increasing_id().alias("row"), cut.alias("pieces"))
    rows = rows.select(id, "row", _joined(F.col("pieces")).alias("n")).select(id, "row", "n.*").withColumn("present", F.array_distinct(F.transform("hits", lambda h: h["word"])))
    return rows.select(id, "row", "n_words", "present", F.when(_possible(F.col("present")), F.col("hits")).otherwise(F.array().cast("array<struct<at:bigint,word:string>>")).alias("hits"))


def ranks(marks: DataFrame) -> dict[str, int]:
    """Place of each licence word, the rarest first: by documents that have it, then the word. One count per word of the vocabulary."""
    counts = {r["word"]: r["n"] for r in marks.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {word: i for i, word in enumerate(sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w)))}


def found(marks: DataFrame, rank: dict[str, int]) -> DataFrame:
    """row, template, start, share: the templates that stand in the files of ``marks``."""
    postings = marks.sparkSession.sql(f"SELECT template, CAST(q AS BIGINT) AS q, word, must FROM VALUES {_VALUES} AS v(template, q, word, must)")
    sizes = postings.groupBy("template").agg(F.count("*").alias("words"), F.count_if("must").alias("musts"))
    files = marks.where(F.size("hits") > 0)
    # Each file's rarest words of each template, from the list of its words.
    order = {t: sorted({word for n, _, word, _ in POSTINGS if n == t}, key=rank.get) for t in range(len(TEMPLATES))}
    rarest = [F.struct(F.lit(t).alias("template"), F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.array_contains("present", w)), 1, ANCHORS).alias("anchors")) for t, words in order.items()]
    anchors = files.select("row", F.explode(F.array(*rarest)).alias("a")).select("row", "a.*").select("row", "template", F.size("anchors").alias("of"), F.explode("anchors").alias("word"))
    places = files.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    # Proposals of anchors, met by start.
    asked = anchors.join(F.broadcast(postings.select("template", "word", "q")), ["template", "word"])
    proposed = places.join(asked, ["row", "word"]).select("row", "template", "of", "word", (F.col("at") - F.col("q")).alias("start")).where("start >= 0")
    starts = proposed.groupBy("row", "template", "start", "of").agg(F.countDistinct("word").alias("votes")).where("2 * votes >= of")
    # All words of the candidates at their places.
    wanted = starts.join(F.broadcast(postings), "template").select("row", "template", "start", (F.col("start") + F.col("q")).alias("at"), "word", "must")
    there = wanted.join(places, ["row", "at", "word"]).groupBy("row", "template", "start").agg(F.count("*").alias("got"), F.count_if("must").alias("kept"))
    return there.join(F.broadcast(sizes), "template").where("kept = musts").select("row", "template", "start", (F.col("got") / F.col("words")).alias("share"))


def licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    scratch = Scratch(docs.sparkSession, "licenses")
    marks = scratch.save(noted(docs, id, text), "marks")
    label = F.element_at(F.array(*[F.lit(x) for x, _, _ in TEMPLATES]), F.col("template") + 1)
    base = F.col("template") < len(BASE)
    per = found(marks, ranks(marks)).withColumn("label", label).groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max(F.when(base, F.col("share") * MENTION).otherwise(F.col("share"))).alias("score"),
    )
    zero = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = marks.select("row", id, "n_words").join(scratch.save(per, "found"), "row", "left")
    return out.select(id, "n_words", *[F.coalesce(c, zero[c]).alias(c) if c in zero else c for c in per.columns if c != "row"])


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))


QUERIES = {"op11_licenses": op11_licenses}

_LABELS = ", ".join(f"({t}, '{label}')" for t, (label, _, _) in enumerate(TEMPLATES))
ORACLE = {
    "op11_licenses": rf"""
WITH postings(template, q, word, must) AS (VALUES {_VALUES}), labelled(template, label) AS (VALUES {_LABELS}),
files AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT r, i - 1 AS pos, w[i] AS word FROM files, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] IN (SELECT word FROM postings)
), present AS (SELECT DISTINCT r, word FROM places
), counted AS (SELECT word, count(*) AS n FROM present GROUP BY word
), anchors AS (
  SELECT r, template, word, least({ANCHORS}, count(*) OVER (PARTITION BY r, template)) AS n_anchors
  FROM present JOIN (SELECT DISTINCT template, word FROM postings) USING (word) JOIN counted USING (word)
  QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY n, word) <= {ANCHORS}
), starts AS (
  SELECT r, template, pos - q AS start FROM anchors JOIN postings USING (template, word) JOIN places USING (r, word) WHERE pos >= q
  GROUP BY ALL HAVING 2 * count(DISTINCT word) >= any_value(n_anchors)
), stands AS (
  SELECT s.r, s.template, start, count(p.word) AS got, count(*) AS words FROM starts s JOIN postings t ON t.template = s.template LEFT JOIN places p ON p.r = s.r AND p.pos = start + q AND p.word = t.word
  GROUP BY ALL HAVING count(*) FILTER (must AND p.word IS NULL) = 0
), per AS (
  SELECT r, count(*) FILTER (template < {len(BASE)}) AS n_base, min(start) FILTER (template < {len(BASE)}) AS first_word, max(start) FILTER (template < {len(BASE)}) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (template < {len(BASE)}))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
    max(got / words * CASE WHEN template < {len(BASE)} THEN {MENTION}::DOUBLE ELSE 1 END) AS score
  FROM stands JOIN labelled USING (template) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM files LEFT JOIN per USING (r)
"""
}
