"""License scans by diagonal voting, in DataFrame functions alone.

Every rolling k-gram of words is hashed and joined to the positions of all k-grams of the license templates.
A hit whose words are not those of the template is no hit. Hits vote for their diagonal, document position minus template
position. Neighbouring diagonals, those within MERGE words, are merged around each diagonal: it counts the different template positions
that it and its neighbours hit, so words that repeat don't count twice, and a merged span is never longer than
the template by more than MERGE on either side. Of neighbours the one that counts most (then the one with most hits of its own, then the first) stands for the span.

A span is verified by words: some stretch that starts on the diagonal, or a word or two off, has to be within a fifth of the template's
words (one at least) by edit distance, and to hold the template's marked words as they are. Counting only
goes before that: a text within e edits of a template of n words shares n - k + 1 - k * e of its k-grams (e below n / k), so
no such span is lost, as long as insertions and deletions don't outnumber each other by more than MERGE.

Only hits leave the scan, each with the words around it (a template's length): a few rows for each license text, aggregated before
the shuffle, so neither long documents nor hot groups gather anywhere. Time grows in proportion to a text's words.

Defined results: null and empty texts have no words, no labels (empty strings), score 0 and null
positions; every row of repeated rows has its own result; empty tables give no rows; texts are scanned whole, however long;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
MERGE = 8
#: Edits that a span may have: one for this many words of the template, one at least.
WORDS_AN_EDIT = 5
#: What is tried for a span: words that it starts off its diagonal, and words that it has more than the template.
SHIFTS = [0, -1, 1, -2, 2]
STRETCHES = [0, -1, 1, -2, 2]
#: k-grams of templates that may be broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 200_000
#: Words of a template are compared as single characters, so it has this many different ones at most.
MOST_DISTINCT = 126
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase and label of the base rule.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license texts and notices, as words. Words in capitals must stand in a span as they are, runs of them together.
TEMPLATES = {
    "agpl-notice": "licensed under the GNU AFFERO GENERAL PUBLIC license version 3",
    "agpl-header": "this program is free software you can redistribute it and or modify it under the terms of the GNU AFFERO GENERAL PUBLIC license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-2.0-notice": "licensed under the APACHE license version 2 0",
    "apache-2.0-header": "licensed under the APACHE license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-clause-text": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by-notice": "licensed under a creative commons ATTRIBUTION 4 0 international license",
    "cc-by-nc-notice": "licensed under CC BY NC 4 0",
    "cc-by-sa-notice": "licensed under CC BY SA 4 0",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the GNU GENERAL PUBLIC license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the GNU GENERAL PUBLIC license for more details",
    "gpl-notice": "this work is licensed under the GNU GENERAL PUBLIC license version 3",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-header": "this library is free software you can redistribute it and or modify it under the terms of the GNU LESSER GENERAL PUBLIC license as published by the free software foundation",
    "mit-notice": "is released under the MIT license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0-header": "this source code form is subject to the terms of the MOZILLA public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
}


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def edits_of(n_words: int) -> int:
    return max(1, n_words // WORDS_AN_EDIT)


def marked_runs(text: str) -> list[str]:
    """The runs of words in capitals, in lower case."""
    out, last = [], False
    for word in text.split():
        marked = word.isupper()
        if marked and last:
            out[-1] += " " + word.lower()
        elif marked:
            out.append(word.lower())
        last = marked
    return out


def checked_templates(templates: dict[str, str], k: int) -> list[tuple[int, str, list[str], list[str]]]:
    """(number, label, words, marked runs) of every template."""
    out = []
    for tid, (label, text) in enumerate(sorted(templates.items())):
        words = text.lower().split()
        if len(words) < 2 * k or len(set(words)) > MOST_DISTINCT:
            raise ValueError(f"{label}: a template has at least {2 * k} words and at most {MOST_DISTINCT} different ones")
        out.append((tid, label, words, marked_runs(text)))
    return out


def template_grams(spark: SparkSession, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """One row for each k-gram of each template: h, tid, tpos, its words, and the template's length."""
    rows = [(tid, i, words[i : i + k], len(words)) for tid, _, words, _ in checked_templates(templates, k) for i in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "tid int, tpos int, tgram array<string>, twords int")
    df = df.select(F.xxhash64(*[F.col("tgram")[i] for i in range(k)]).alias("h"), "tid", "tpos", "twords", *[F.col("tgram")[i].alias(f"tw{i}") for i in range(k)])
    return F.broadcast(df) if len(rows) <= BROADCAST_GRAMS else df


def template_texts(spark: SparkSession, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """One row for each template: tid, label, its different words, its words as characters, marked runs, edits and the k-grams that a span needs."""
    rows, n = [], 0
    for tid, label, words, runs in checked_templates(templates, k):
        known = list(dict.fromkeys(words))
        edits = edits_of(len(words))
        chars = lambda ws: "".join(chr(1 + known.index(w)) for w in ws)
        rows.append((tid, label, known, chars(words), [chars(r.split()) for r in runs], edits, max(1, len(words) - k + 1 - k * edits)))
        n += len(words)
    df = spark.createDataFrame(rows, "tid int, label string, known array<string>, tchars string, runs array<string>, edits int, least int")
    return F.broadcast(df) if n <= BROADCAST_GRAMS else df


def _places(words: Column, phrase: str) -> Column:
    """Positions, from 0, where the words of a phrase stand consecutively."""
    parts = phrase.split()
    match = lambda i: [words[i + j] == p for j, p in enumerate(parts)]

    def fits(i):
        out = match(i)[0]
        for m in match(i)[1:]:
            out = out & m
        return out

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), fits)).otherwise(F.array().cast("array<int>"))


def _least_start() -> Column:
    return F.greatest(F.col("diagonal") + min(SHIFTS), F.lit(0))


def verified_span() -> Column:
    """The best stretch of ``around`` (words, from the least start on) as struct(edits, at, first, size), or null: fewest edits, then the
    order in which stretches are tried. Words are compared as characters: those of the template by number, all others as one."""

    def tried(chars, at, shift, change):
        start = F.col("diagonal") + shift
        size = F.col("twords") + change + F.least(start, F.lit(0))  # a template may begin before the text does
        first = F.greatest(start, F.lit(0))
        part = F.when(size > 0, F.substring(chars, first - _least_start() + 1, size)).otherwise("")
        return F.struct(part.alias("part"), F.lit(at).alias("at"), first.alias("first"))

    def best(chars):
        parts = F.array(*[tried(chars, i * len(STRETCHES) + j, x, y) for i, x in enumerate(SHIFTS) for j, y in enumerate(STRETCHES)])
        marked = F.filter(parts, lambda p: F.forall("runs", lambda r: F.contains(p["part"], r)))
        told = F.transform(marked, lambda p: F.struct(F.call_function("levenshtein", p["part"], F.col("tchars"), F.col("edits")).alias("edits"), p["at"].alias("at"), p["first"].alias("first"), F.length(p["part"]).alias("size")))
        return F.array_min(F.filter(told, lambda x: x["edits"] >= 0))

    number = lambda w: F.coalesce(F.nullif(F.array_position("known", w), F.lit(0)), F.lit(MOST_DISTINCT + 1))
    chars = F.array_join(F.transform("around", lambda w: F.char(number(w))), "")
    return F.get(F.transform(F.array(chars), best), F.lit(0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, spans (label, first, last, share), labels, score of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), words_of(F.col(text_col).cast("string")).alias("words"))
    # A phrase can only stand where its last word does: most documents need no second look.
    none = F.array().cast("array<int>")
    places = {label: F.when(F.array_contains("words", phrase.split()[-1]), _places(F.col("words"), phrase)).otherwise(none) for phrase, label in PHRASES.items()}
    rows = rows.withColumns({"n_words": F.size("words").cast("long")} | {f"at_{label}": at for label, at in places.items()})
    every = F.concat(*[F.col(f"at_{label}") for label in places])
    doc = ["rid", "doc_id", "n_words", "n_base", "first_word", "last_word", *[f"has_{label}" for label in places]]
    based = rows.select(
        "doc_id", "rid", "words", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        *[(F.size(f"at_{label}") > 0).alias(f"has_{label}") for label in places],
    )
    # From here to the partial aggregate all is compiled into one loop over the words, which are copied for hits alone.
    word = lambda i: F.get("words", F.col("pos") + i)
    dealt = based.select(*doc, "words", F.posexplode_outer("words").alias("pos", "word")).drop("word")
    dealt = dealt.withColumn("h", F.when(F.col("pos") + k <= F.size("words"), F.xxhash64(*[word(i) for i in range(k)])))
    grams = template_grams(spark, templates, k)
    same = dealt["h"] == grams["h"]
    for i in range(k):
        same = same & (word(i) == grams[f"tw{i}"])
    met = dealt.join(grams, same, "left").where(F.col("tid").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    met = met.withColumn("diagonal", F.col("pos") - F.col("tpos"))
    around = F.when(F.col("tid").isNotNull(), F.slice("words", _least_start() + 1, F.col("twords") + (max(SHIFTS) - min(SHIFTS) + max(STRETCHES))))
    hits = met.select(*doc, "tid", "twords", "tpos", "diagonal", around.alias("around"))

    voted = hits.groupBy(*doc, "tid", "twords", "diagonal").agg(F.collect_list("tpos").alias("voters"), F.first("around").alias("around"))
    near = Window.partitionBy("rid", "tid").orderBy("diagonal").rangeBetween(-MERGE, MERGE)
    merged = voted.withColumn("votes", F.size(F.array_distinct(F.flatten(F.collect_list("voters").over(near)))).cast("long"))
    # Most votes of the neighbourhood, then most of its own, then the first diagonal.
    order = F.shiftleft(F.col("votes"), 43) + F.shiftleft(F.size("voters").cast("long"), 33) - F.col("diagonal")
    spans = merged.withColumn("order", order).drop("voters").withColumn("best", F.max("order").over(near))
    spans = spans.join(template_texts(spark, templates, k), "tid", "left")
    sound = F.col("tid").isNotNull() & (F.col("order") == F.col("best")) & (F.col("votes") >= F.col("least"))
    spans = spans.withColumn("span", F.when(sound, verified_span()))
    first = F.col("span.first").cast("long")
    found = F.struct("label", first.alias("first"), (first + F.col("span.size") - 1).alias("last"), (F.lit(1.0) - F.col("span.edits") / F.col("twords")).alias("share"))
    spans = spans.withColumn("found", F.when(F.col("span").isNotNull(), found))
    out = spans.groupBy(*doc).agg(F.array_sort(F.collect_list("found")).alias("spans"))
    base = F.filter(F.array(*[F.when(F.col(f"has_{label}"), F.lit(label)) for label in sorted(places)]), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"), "spans", F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def license_digest(scanned: DataFrame) -> DataFrame:
    return scanned.drop("spans")


def license_sql(templates: dict[str, str] = TEMPLATES, k: int = K) -> str:
    """The same in DuckDB SQL."""
    texts = []
    for tid, label, words, runs in checked_templates(templates, k):
        edits, known = edits_of(len(words)), list(dict.fromkeys(words))
        listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
        texts.append(f"({tid}, '{label}', string_split('{' '.join(words)}', ' '), string_split('{' '.join(known)}', ' '), {listed(runs)}, {edits}, {max(1, len(words) - k + 1 - k * edits)})")
    places = ", ".join(
        f"list_filter(range(0, len(words)), lambda i: {' AND '.join(f'words[i + {j + 1}] = {chr(39)}{p}{chr(39)}' for j, p in enumerate(phrase.split()))}) AS at_{label}" for phrase, label in PHRASES.items()
    )
    labels = sorted(PHRASES.values())
    base = ", ".join(f"CASE WHEN len(at_{x}) > 0 THEN '{x}' END" for x in labels)
    near = f"OVER (PARTITION BY rid, tid ORDER BY diagonal RANGE BETWEEN {MERGE} PRECEDING AND {MERGE} FOLLOWING)"
    chars = lambda ws: f"array_to_string(list_transform({ws}, lambda w: chr(coalesce(nullif(list_position(known, w), 0), {MOST_DISTINCT + 1})::INT)), '')"
    return f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT *, {places} FROM w),
b AS (SELECT doc_id, rid, words, CAST(len(words) AS BIGINT) AS n_words, at_mit || at_apache || at_gpl AS every, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p),
t(tid, label, twords, known, runs, edits, least_grams) AS (VALUES {', '.join(texts)}),
tg AS (SELECT tid, tpos, array_to_string(twords[tpos + 1 : tpos + {k}], ' ') AS gram FROM (SELECT tid, twords, unnest(range(0, len(twords) - {k - 1})) AS tpos FROM t)),
g AS (SELECT rid, unnest(range(0, len(words) - {k - 1})) AS pos, words FROM b WHERE len(words) >= {k}),
h AS (SELECT rid, pos, array_to_string(words[pos + 1 : pos + {k}], ' ') AS gram FROM g),
v AS (SELECT rid, tid, pos - tpos AS diagonal, list(tpos) AS voters FROM h JOIN tg USING (gram) GROUP BY ALL),
m AS (SELECT rid, tid, diagonal, CAST(len(list_distinct(flatten(list(voters) {near}))) AS BIGINT) AS votes, len(voters) AS own FROM v),
r AS (SELECT *, votes * 8796093022208 + own * 8589934592 - diagonal AS place FROM m),
o AS (SELECT *, max(place) {near} AS best FROM r),
a AS (SELECT o.rid, diagonal, label, twords, known, runs, edits, words FROM o JOIN t USING (tid) JOIN b ON b.rid = o.rid WHERE place = best AND votes >= least_grams),
s AS (SELECT rid, label, len(twords) AS n, edits, runs, words[greatest(diagonal + shift, 0) + 1 : greatest(diagonal + shift, 0) + greatest(len(twords) + change + least(diagonal + shift, 0), 0)] AS part, twords, known
    FROM a, (SELECT unnest({STRETCHES}) AS change), (SELECT unnest({SHIFTS}) AS shift)),
e AS (SELECT rid, label, n, edits, levenshtein({chars('part')}, {chars('twords')}) AS distance FROM s WHERE len(list_filter(runs, lambda r: NOT contains(' ' || array_to_string(part, ' ') || ' ', ' ' || r || ' '))) = 0),
l AS (SELECT rid, list(label) AS labels, max(1 - CAST(distance AS DOUBLE) / n) AS share FROM e WHERE distance <= edits GROUP BY rid)
SELECT doc_id, n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
    array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
    CASE WHEN len(every) > 0 THEN 1.0 ELSE CAST(coalesce(share, 0) AS DOUBLE) END AS score
FROM b LEFT JOIN l USING (rid)"""
