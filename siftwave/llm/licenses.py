"""License scans by diagonal voting.

Rolling word k-gram hashes of every document are joined with the positions of the same k-grams in the
templates. A match votes for the diagonal (document position minus template position); votes are summed
by diagonal, and diagonals at most `gap` words apart (words inserted or dropped in between) are merged into a
span. A span is verified on both sides: its matched words must cover enough of the template, and enough of the
document's words between its ends. Short phrases are templates too, with bigrams; they must be covered whole on
one diagonal.

Every vote compares the words themselves, so hash collisions can't vote. Words are exploded once in one
pass of built-in functions; only votes and one row per document are shuffled, votes summed before. The
templates are fixed and small, so they are broadcast.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; rows equal in
doc_id and text are one document; a null doc_id is a document of its own for each different text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwave.llm.common import ascii_words, keyed

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Whole public licenses, without their titles and copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
#: Public license notices; the labels are the method's own.
NOTICES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-line": "Released under the MIT License.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "mit-text": MIT,
    "isc-text": ISC,
    "bsd-3-text": BSD,
    "zlib-text": ZLIB,
    "unlicense-text": UNLICENSE,
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
LONG_K, PHRASE_K = 4, 2


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """tid, label, base, words."""
    rows = [(i, label, True, text) for i, (text, label) in enumerate(phrases.items())]
    rows += [(len(rows) + i, label, False, text) for i, (label, text) in enumerate(notices.items())]
    return spark.createDataFrame(rows, "tid int, label string, base boolean, text string").select("tid", "label", "base", ascii_words(F.col("text")).alias("words"))


def gram_index(tpl: DataFrame, k: int) -> DataFrame:
    """h, gram (the k words) and hits (tid, tpos): one row for each k-gram of the templates."""
    at = tpl.filter(F.size("words") >= k).select("tid", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("tpos"))
    grams = at.select("tid", "tpos", F.slice("words", F.col("tpos") + 1, k).alias("gram"))
    by_gram = grams.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("tid", "tpos"))).alias("hits"))
    return by_gram.select(F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(k)]).alias(f"h{k}"), F.col("gram").alias(f"gram{k}"), F.col("hits").alias(f"hits{k}"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, min_cover: float = 0.6, min_dense: float = 0.6, gap: int = 3) -> DataFrame:
    """doc_id, n_words, spans (label, base, start, end, cover, dense) of each document: words from `start` to before `end`,
    the share of the template that they cover, and the share of them that is matched."""
    tpl = templates(docs.sparkSession, phrases, notices)
    rows = keyed(docs).select("doc_id", "th", ascii_words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "th", "words", F.posexplode_outer("words").alias("at", "word"))
    word = lambda i: F.get("words", F.col("at") + i)
    for k, some in ((PHRASE_K, tpl.filter("base")), (LONG_K, tpl.filter("not base"))):
        rows = rows.withColumn(f"h{k}", F.xxhash64(*[word(i) for i in range(k)])).join(F.broadcast(gram_index(some, k)), f"h{k}", "left")
    same = lambda k: F.col(f"gram{k}") == F.slice("words", F.col("at") + 1, k)
    hits = F.concat(*[F.when(same(k), F.col(f"hits{k}")).otherwise(F.array()) for k in (PHRASE_K, LONG_K)])
    votes = rows.filter(F.col("hits2").isNotNull() | F.col(f"hits{LONG_K}").isNotNull() | F.coalesce(F.col("at") == 0, F.lit(True)))
    votes = votes.select("doc_id", "th", "at", F.size("words").alias("n_words"), F.explode_outer(hits).alias("hit"))
    votes = votes.select("doc_id", "th", "n_words", "hit.tid", (F.col("at") - F.col("hit.tpos")).alias("diag"), F.col("hit.tpos").alias("tpos"))
    by_diag = votes.groupBy("doc_id", "th", "n_words", "tid", "diag").agg(F.collect_set("tpos").alias("tposes"))

    # Neighbouring diagonals of a notice join while each step is at most `gap` words.
    info = F.broadcast(tpl.select("tid", "label", "base", F.size("words").alias("len")))
    order = Window.partitionBy("doc_id", "th", "n_words", "tid").orderBy("diag")
    k = F.when(F.col("base"), PHRASE_K).otherwise(LONG_K)
    lines = by_diag.join(info, "tid", "left").withColumn("new", F.when(F.col("base") | (F.col("diag") - F.lag("diag").over(order) > gap), 1).otherwise(0))
    lines = lines.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy("doc_id", "th", "n_words", "tid", "run", "label", "base", "len").agg(
        F.min(F.col("diag") + F.array_min("tposes")).alias("start"),
        F.max(F.col("diag") + F.array_max("tposes") + k).alias("end"),
        F.array_distinct(F.flatten(F.collect_list("tposes"))).alias("tposes"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("tposes", lambda p: p + F.col("diag"))))).alias("places"),
    )
    words = lambda starts: F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + k - 1)))))
    known = F.col("tid").isNotNull()
    spans = merged.withColumns({"cover": F.when(known, words("tposes") / F.col("len")), "dense": F.when(known, words("places") / (F.col("end") - F.col("start")))})
    good = F.when(F.col("base"), F.col("cover") == 1.0).otherwise((F.col("cover") >= min_cover) & (F.col("dense") >= min_dense))
    span = F.when(good, F.struct("label", "base", "start", "end", "cover", "dense"))
    return spans.groupBy("doc_id", "th").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_list(span)).alias("spans"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
