"""Licence scans through a positional index of rare words; DataFrame functions only.

Each template has a mandatory phrase. Its two rarest words, by inverse document frequency over all texts, are its
postings, each with its position in the template. The index is a map from a template's rarest word to the postings of all
templates that have it so. A file looks up its own words in that map, those of the highest inverse document frequency
first; a file without such a word reads no posting. Of the templates found, those of which the file holds the next rarest
word too remain, the positions of both words, each less its position in the template, are intersected, and where they
agree the phrase must stand in full and enough of the template's words must be at their places. Wherever a phrase stands,
both its words stand too, so no place is missed.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's labels and phrases.
BASE = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
# Label, notice as its licence words it, mandatory phrase.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu general public license"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    ("agpl", "licensed under the GNU Affero General Public License", "affero general public license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        "use this file except in compliance",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
        "to deal in the software without restriction",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        "use in source and binary forms",
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        "endorse or promote products derived from this software",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "this permission notice appear in all copies",
    ),
    (
        "0bsd",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES""",
        "granted the software is provided",
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        "foundation either version 2 of the license",
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        "foundation either version 3 of the license",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY""",
        "lesser general public license as published by the free software foundation",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY""",
        "affero general public license as published by the free software foundation",
    ),
    (
        "gfdl",
        """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation
        License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no
        Front-Cover Texts, and no Back-Cover Texts.""",
        "gnu free documentation license",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
    (
        "mpl-1.1",
        """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/""",
        "mozilla public license version 1 1",
    ),
    (
        "epl-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
        "eclipse public license 2 0",
    ),
    (
        "epl-1.0",
        """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse
        Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
        "eclipse public license v1 0",
    ),
    (
        "cddl-1.0",
        """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").
        You may not use this file except in compliance with the License.""",
        "common development and distribution license",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        "free and unencumbered software released into the public domain",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented""",
        "alter it and redistribute it freely",
    ),
    (
        "bsl-1.0",
        """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
        https://www.boost.org/LICENSE_1_0.txt)""",
        "boost software license",
    ),
    (
        "wtfpl",
        """This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can
        redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as
        published by Sam Hocevar. See http://www.wtfpl.net/ for more details.""",
        "do what the fuck you want to public license",
    ),
    (
        "cc0-1.0",
        """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
        this software to the public domain worldwide. This software is distributed without any warranty. You should have
        received a copy of the CC0 Public Domain Dedication along with this software.""",
        "related and neighboring rights to this software",
    ),
    (
        "cc-by-4.0",
        """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/""",
        "creative commons attribution 4 0 international license",
    ),
    (
        "cc-by-sa",
        """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by-sa/4.0/""",
        "creative commons attribution sharealike",
    ),
    (
        "cc-by-nc",
        """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
        "creative commons attribution noncommercial 4 0",
    ),
    (
        "cc-by-nc-sa",
        """This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To
        view a copy of this license, visit http://creativecommons.org/licenses/by-nc-sa/4.0/""",
        "creative commons attribution noncommercial sharealike",
    ),
    (
        "cc-by-nd",
        """This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by-nd/4.0/""",
        "creative commons attribution noderivatives",
    ),
    (
        "artistic-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.
        You may copy and distribute verbatim copies of the Standard Version of the source form""",
        "artistic license 2 0",
    ),
    (
        "postgresql",
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
        without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the
        following two paragraphs appear in all copies.""",
        "without a written agreement is hereby granted",
    ),
    (
        "ncsa",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimers in the documentation and/or other materials provided with the distribution.""",
        "and the following disclaimers redistributions in binary form",
    ),
    (
        "ofl-1.1",
        """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also
        available with a FAQ at: http://scripts.sil.org/OFL""",
        "sil open font license",
    ),
    (
        "ms-pl",
        """This license governs use of the accompanying software. If you use the software, you accept this license. If you do not
        accept the license, do not use the software. Microsoft Public License (Ms-PL)""",
        "microsoft public license",
    ),
    (
        "eupl-1.2",
        """Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent
        versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.""",
        "soon they will be approved by the european commission",
    ),
    (
        "psf-2.0",
        """This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization
        ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated
        documentation.""",
        "accessing and otherwise using this software",
    ),
    (
        "odbl-1.0",
        """This database is made available under the Open Database License. Any rights in individual contents of the database are
        licensed under the Database Contents License""",
        "open database license",
    ),
    (
        "openssl",
        """All advertising materials mentioning features or use of this software must display the following acknowledgment: "This
        product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.\"""",
        "software developed by the openssl project",
    ),
    (
        "beerware",
        """As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this
        stuff is worth it, you can buy me a beer in return.""",
        "you can buy me a beer in return",
    ),
    (
        "json",
        """The Software shall be used for Good, not Evil.""",
        "shall be used for good not evil",
    ),
    (
        "upl-1.0",
        """The Universal Permissive License (UPL), Version 1.0. Subject to the condition set forth below, permission is hereby
        granted to any person obtaining a copy of this software, associated documentation and/or data""",
        "universal permissive license",
    ),
    (
        "public-domain",
        """This work has been identified as being free of known restrictions under copyright law, including all related and
        neighboring rights. It has been placed in the public domain.""",
        "free of known restrictions under copyright law",
    ),
)
#: A notice holds if its phrase stands and at least this share of its words are at their places.
LEAST_SHARE = 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@cache
def templates() -> list[tuple[bool, str, list[str], list[str], int]]:
    """(base, label, phrase, notice, where the phrase stands in the notice), words lower-cased."""
    split = lambda text: re.findall(r"[a-z0-9]+", text.lower())
    out = []
    for i, (label, notice, phrase) in enumerate(BASE + NOTICES):
        n, p = split(notice), split(phrase)
        at = [k for k in range(len(n)) if n[k : k + len(p)] == p]
        if not at:
            raise ValueError(f"{label}: the notice doesn't hold its phrase")
        out.append((i < len(BASE), label, p, n, at[0]))
    return out


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased. Other letters may change as well, but the Kelvin sign must not become a k."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("å"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def vocabulary() -> list[str]:
    return sorted({w for _, _, p, _, _ in templates() for w in p})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each word of the phrases over all texts."""
    vocab = vocabulary()
    own = F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocab)))
    # One row for each word of the fixed vocabulary, and one for the number of texts.
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("w")).groupBy("w").count().collect()
    df = {r[0]: r[1] for r in counts}
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocab}


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _postings(idf: dict[str, float]) -> list[dict]:
    """For each template the two rarest words that stand once in its phrase (the first on ties), the rarest templates first."""
    out = []
    for base, label, p, n, inside in templates():
        once = sorted((w for w in p if p.count(w) == 1), key=lambda w: (-idf[w], p.index(w)))
        if len(once) < 2:
            raise ValueError(f"{label}: fewer than two words stand once in its phrase")
        a, b = once[:2]
        out.append({"base": base, "label": label, "rare": a, "next": b, "phrase": p, "notice": n, "inside": inside, "at_rare": p.index(a), "at_next": p.index(b)})
    return sorted(out, key=lambda x: -idf[x["rare"]])


def _index(postings: list[dict]) -> tuple[Column, Column]:
    """(rarest word -> its templates' postings, rarest word -> its rank, 0 being the rarest) as map literals."""
    names = ("base", "label", "rare", "next", "inside", "at_rare", "at_next")
    by_word: dict[str, list[Column]] = {}
    for p in postings:
        entry = F.struct(*(F.lit(p[k]).alias(k) for k in names), _strings(p["phrase"]).alias("phrase"), _strings(p["notice"]).alias("notice"))
        by_word.setdefault(p["rare"], []).append(entry)
    return (
        F.create_map(*(c for w, entries in by_word.items() for c in (F.lit(w), F.array(*entries)))),
        F.create_map(*(F.lit(x) for rank, w in enumerate(by_word) for x in (w, rank))),
    )


FOUND = "array<struct<base:boolean,label:string,start:bigint,share:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, places array<struct<label,start>>, notices array<struct<label,start,share>>), a row for each row.

    places are those of the base phrases, notices those of the method, by start; starts count words from 0, those of
    notices may lie before the text. Null and empty texts have no words; rows that repeat are told alike; of equally rare
    words the first in the phrase is taken, which changes no result. The index is a literal of each row's expression:
    nothing is joined or shuffled.
    """
    idf = idf or document_frequencies(docs, text_col)
    postings = _postings(idf)
    anchors = sorted({p[k] for p in postings for k in ("rare", "next")})
    index, rank = _index(postings)
    rare = sorted({p["rare"] for p in postings})
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    # The file's own postings: anchor words and where they stand.
    rows = rows.withColumn("hits", F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(anchors), F.struct(x.alias("word"), i.alias("at"))))))
    rows = rows.withColumn("own", F.array_distinct("hits.word"))
    # Those of its words by which templates are found, the rarest first.
    ranked = F.transform(F.filter("own", lambda w: w.isin(rare)), lambda w: F.struct(rank[w].alias("rank"), w.alias("word")))
    rows = rows.withColumn("asked", F.sort_array(ranked)["word"])

    def starts(word: Column, inside: Column) -> Column:
        """Where the phrase would begin for each place of this word."""
        return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - inside)

    def stands(p: Column, at: Column) -> Column:
        return (at >= 0) & (F.slice(F.col("w"), F.greatest(at, F.lit(0)) + 1, F.size(p["phrase"])) == p["phrase"])

    def place(p: Column, at: Column) -> Column:
        first = at - p["inside"]
        near = F.transform(p["notice"], lambda x, k: F.when((first + k >= 0) & (F.get(F.col("w"), first + k) == x), 1))
        share = F.size(F.array_compact(near)) / F.size(p["notice"])
        return F.struct(p["base"].alias("base"), p["label"].alias("label"), first.cast("long").alias("start"), share.alias("share"))

    def looked_up(p: Column) -> Column:
        agreed = F.array_intersect(starts(p["rare"], p["at_rare"]), starts(p["next"], p["at_next"]))
        return F.transform(F.filter(agreed, lambda at: stands(p, at)), lambda at: place(p, at))

    candidates = F.filter(F.flatten(F.transform("asked", lambda w: index[w])), lambda p: F.array_contains(F.col("own"), p["next"]))
    found = F.flatten(F.transform(candidates, looked_up))
    rows = rows.withColumn("found", F.when((F.size("asked") > 0) & (F.size("own") > 1), found).otherwise(F.array().cast(FOUND)))
    order = lambda x: F.struct(x["start"].alias("start"), x["label"].alias("label"), x["share"].alias("share"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.sort_array(F.transform(F.filter("found", lambda x: x["base"]), order)).alias("places"),
        F.sort_array(F.transform(F.filter("found", lambda x: ~x["base"] & (x["share"] >= LEAST_SHARE)), order)).alias("notices"),
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of what ``scan`` found, row by row.

    Texts without a base phrase have null first_word and last_word and empty base_labels; texts without any place have
    empty labels and score 0.
    """
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    starts = F.transform("places", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("places")).alias("base_labels"),
        joined(F.concat(names("places"), names("notices"))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("places", "notices"), lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """The same digest in DuckDB SQL: every phrase is looked for at every word."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = [f"({str(base).lower()}, '{label}', {quoted(p)}, {quoted(n)}, {inside})" for base, label, p, n, inside in templates()]
    return rf"""
WITH t(base, label, phrase, notice, inside) AS (VALUES {", ".join(rows)}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), stand AS (
  SELECT doc_id, w, base, label, notice, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS i, inside FROM d, t
  WHERE list_has_all(w, phrase)
), f AS (
  SELECT doc_id, base, label, i AS start,
    len(list_filter(range(len(notice)), lambda k: i - inside + k >= 0 AND w[i - inside + k + 1] = notice[k + 1])) / len(notice) AS share
  FROM stand
), h AS (SELECT * FROM f WHERE base OR share >= {LEAST_SHARE})
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM h GROUP BY doc_id) x USING (doc_id)
"""
