"""Operator 2: licence scan with a positional rare-token index; DataFrame functions only.

A template is a stretch of licence text with mandatory key phrases. Each is indexed under its mandatory word of the
highest inverse document frequency, with that word's position. A file's occurrences of index words fetch templates,
the difference of the two positions proposes where the template would start, the next rarest mandatory word must stand
at the same offset, then all mandatory words are verified and the share of matching template words is the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``must``: key phrases, each a run of the template's words; empty: the whole text is mandatory. ``base``: counted as a base place."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    base: bool = field(default=False)

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def positions(self) -> list[int]:
        """Positions of the mandatory words."""
        out: set[int] = set()
        for phrase in self.must or (self.text,):
            p = phrase.split()
            out |= {k + j for k in range(len(self.words)) if self.words[k : k + len(p)] == p for j in range(len(p))}
        return sorted(out)


BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
# Texts of licences and of the notices by which they are applied, in lower-case words.
PERMISSION = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
    "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
    "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the software"
)
AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
REDISTRIBUTION = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
    "other materials provided with the distribution"
)
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", PERMISSION, ("hereby granted free of charge", "associated documentation files")),
    Template("mit", f"{PERMISSION} {AS_IS}", ("hereby granted free of charge", "associated documentation files", "warranties of merchantability")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "required by applicable law", "as is basis"),
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("redistribute it", "gnu general public license"),
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("bsd-2-clause", REDISTRIBUTION, ("source and binary forms", "must reproduce the above copyright notice")),
    Template(
        "bsd-3-clause",
        f"{REDISTRIBUTION} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("source and binary forms", "endorse or promote products", "specific prior written permission"),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("held liable for any damages", "alter it and redistribute it freely"),
    ),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software", "public domain"),
    ),
)


def words_column(text_col: str) -> Column:
    low = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def document_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each licence word stands; as many counts as there are licence words."""
    held = F.array_intersect(F.col("_words"), F.array(*map(F.lit, vocabulary)))
    return {r["w"]: r["count"] for r in words.select(F.explode(held).alias("w")).groupBy("w").count().collect()}


def rarest(t: Template, counts: dict[str, int]) -> list[int]:
    """Positions of the mandatory words from the highest inverse document frequency down."""
    return sorted(t.positions, key=lambda j: (counts.get(t.words[j], 0), t.words[j], j))


def posting(t: Template, counts: dict[str, int]) -> tuple[str, Column]:
    """A template's rarest mandatory word, and what is held under it: its position, the next rarest word and position, and the template."""
    words, rare = t.words, rarest(t, counts)
    second = rare[1] if len(rare) > 1 else rare[0]
    held = F.struct(
        F.lit(rare[0]).alias("at"), F.lit(words[second]).alias("next"), F.lit(second).alias("next_at"), F.array(*map(F.lit, words)).alias("words"),
        F.array(*map(F.lit, t.positions)).alias("must"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
    )
    return words[rare[0]], held


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES, *, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """Adds n_words and ``matches`` (start word, label, base, score) to each document; only word counts are shuffled.

    The index maps each template's rarest word to its postings. A document's index words fetch their postings; a
    template matches where all mandatory words stand and at least ``least`` of all its words do; its start may lie
    before the text's first word. All places count, also overlapping ones.

    Null and empty texts have no words and no matches. Repeated rows and extra columns of any name stay as they are,
    but n_words and matches are replaced. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "matches")]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), words_column(text_col).alias("_words"))
    vocabulary = sorted({t.words[j] for t in templates for j in t.positions})
    counts = document_counts(base.select("_words"), vocabulary)
    by_word: dict[str, list[Column]] = {}
    for t in templates:
        word_, held = posting(t, counts)
        by_word.setdefault(word_, []).append(held)
    index = F.create_map(*[x for w, held in sorted(by_word.items()) for x in (F.lit(w), F.array(*held))])
    word = lambda i: F.get(F.col("_words"), i)
    places = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(*by_word), i).otherwise(-1)), lambda i: i >= 0)
    fetched = F.flatten(
        F.transform(
            "_places",
            lambda p: F.transform(
                F.filter(F.element_at(index, word(p)), lambda t: word(p - t["at"] + t["next_at"]).eqNullSafe(t["next"])),
                lambda t: F.struct((p - t["at"]).alias("start"), t.alias("t")),
            ),
        )
    )
    sound = F.filter("_fetched", lambda c: F.forall(c["t"]["must"], lambda j: word(c["start"] + j).eqNullSafe(F.get(c["t"]["words"], j))))
    share = lambda c: F.size(F.filter(F.transform(c["t"]["words"], lambda w, j: word(c["start"] + j).eqNullSafe(w)), lambda x: x)) / F.size(c["t"]["words"])
    scored = F.transform("_sound", lambda c: F.struct(c["start"].alias("start"), c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), share(c).alias("score")))
    return (
        base.withColumn("_places", places)
        .withColumn("_fetched", fetched)
        .withColumn("_sound", sound)
        .withColumn("_matches", F.filter(scored, lambda m: m["score"] >= least))
        .withColumn("_n", F.size("_words").cast("long"))
        .select(*[F.col("row")[c].alias(c) for c in kept], F.col("_n").alias("n_words"), F.col("_matches").alias("matches"))
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    based = found.withColumn("_base", F.filter("matches", lambda m: m["base"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return based.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda m: m["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda m: m["start"])).cast("long").alias("last_word"),
        joined("_base").alias("base_labels"),
        joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """Tries every template at every place."""
    q = lambda s: "'" + s + "'"
    rows = ",\n".join(f"({q(t.label)}, {t.base}, {[*t.words]!r}, {t.positions!r})" for t in BASE + TEMPLATES)
    return f"""
WITH t(label, base, tw, must) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, words FROM w),
c AS (SELECT k, t.*, words, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i] = tw[must[1] + 1])) - must[1] AS p FROM d, t),
s AS (SELECT k, label, base, p - 1 AS start,
  len(list_filter(must, lambda j: p + j >= 1 AND words[greatest(p + j, 1)] = tw[j + 1])) = len(must) AS sound,
  len(list_filter(range(0, len(tw)), lambda j: p + j >= 1 AND coalesce(words[greatest(p + j, 1)] = tw[j + 1], false))) / len(tw) AS score FROM c),
m AS (SELECT k, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM s WHERE sound AND score >= 0.8 GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN m USING (k)"""
