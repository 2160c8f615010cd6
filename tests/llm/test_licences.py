import duckdb

from pyspark.sql import functions as F

from spectrail.llm import licences

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
TEXTS = [
    "words here. Released under the MIT License. more words",
    "# Licensed under the Apache License, Version 2.0.\n// Licensed under CC BY-NC 4.0.",
    "The MIT License (MIT)\n" + MIT,
    MIT,
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "This licence is unknown. All permission is refused",
    "",
    None,
    "Released under the MIT License.\nunknown sentence between.\nReleased under the MIT License",
]


def test_rules(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, rule string")
    got = sorted((r.doc_id, r.rule or "", r.licence or "") for r in licences.scan(docs).collect())
    assert got == sorted([(0, "mit-line", "MIT")] * 2 + [(1, "apache-line", "Apache-2.0"), (1, "cc-by-nc-line", "CC-BY-NC-4.0"), (2, "mit-titled-text", "MIT"), (3, "mit-text", "MIT"), (4, "", ""), (8, "mit-line", "MIT")])
    assert licences.scan(docs.limit(0)).count() == 0


def test_sql_agrees(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = sorted((r.doc_id, str(r.rule), str(r.licence), " ".join(map(str, r.sentence_ids))) for r in licences.scan(docs).collect())
    assert got == sorted((a, str(b), str(c), d) for a, b, c, d in con.sql(licences.op6_sql()).fetchall())


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


# Real notices as they are wrapped in their projects' files.
APACHE_HEADER = """#   Licensed under the Apache License, Version 2.0 (the "License");
#   you may not use this file except in compliance with the License.
#   You may obtain a copy of the License at
#
#       http://www.apache.org/licenses/LICENSE-2.0
#
#   Unless required by applicable law or agreed to in writing, software
#   distributed under the License is distributed on an "AS IS" BASIS,
#   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
#   See the License for the specific language governing permissions and
#   limitations under the License.
import os
"""
MIT_FILE = """The MIT License (MIT)

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
GPL3 = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL2 = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
WRAPPED = {
    "apache-notice": APACHE_HEADER,
    "mit-titled-text": MIT_FILE,
    "mit-text": MIT_FILE.replace("The MIT License (MIT)", "MIT License"),
    "gpl3-notice": GPL3,
    "gpl2-notice": GPL2,
    "bsd3-text": BSD3,
    "bsd2-text": BSD3.split("3. ")[0],
    "isc-text": ISC,
    "mpl2-notice": MPL2,
    "apache-notice-short": APACHE_HEADER.split("#   Unless")[0],
    "cc-by-nc-text": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "gpl3-line": "-- This work is licensed under the\r\n-- GNU General Public License version 3.\r\n",
}


def test_wrapped_notices(spark):
    texts = {f"{end}{rule}": text.replace("\n", end) for rule, text in WRAPPED.items() for end in ("\n", "\r\n")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = [(r.doc_id, r.rule) for r in licences.scan(docs).collect()]
    assert sorted(found) == sorted((k, k.strip()) for k in texts)


def test_each_rule_can_be_met(spark):
    # one text for each rule: its sentences as paragraphs, each on one line
    docs = spark.createDataFrame([(rule, ".\n\n".join(licences.SENTENCES[n] for n in ids)) for rule, _, ids in licences.RULES], "doc_id string, text string")
    assert {(r.doc_id, r.rule) for r in licences.scan(docs).collect()} == {(rule, rule) for rule, _, _ in licences.RULES}


def test_stops_and_blank_lines_part_sentences(spark):
    texts = ["Released under\n\nthe MIT License.", "Released under. the MIT License", "Licensed under the Apache License, Version 2.0.\nThe License\n", "." * 100_000 + "-" * 100_000 + " license\x01", "It is released under the MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.rule) for r in licences.scan(docs).collect()] == [(2, "apache-line")]


MPL_FILE = MPL2.replace("https", "http")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
LGPL = GPL3.replace("program is", "library is").replace("software:", "software;").replace("GNU General Public License as", "GNU Lesser General Public\n * License as").replace("Foundation, either version 3", "Foundation; either\n * version 2.1")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""
MORE = {
    "mpl2-notice": MPL_FILE,
    "zlib-text": ZLIB,
    "unlicense-text": UNLICENSE,
    "boost-text": BSL,
    "lgpl21-notice": LGPL,
    "agpl3-notice": AGPL,
    "gpl3-text": GPL_FILE,
    "apache-text": APACHE_FILE,
    "tag-Apache-2.0": "/* SPDX-License-Identifier: Apache-2.0 */\nint x;",
    "tag-GPL-3.0-or-later": "# SPDX-License-Identifier: GPL-3.0-or-later",
}


def test_more_notices(spark):
    docs = spark.createDataFrame(list(MORE.items()), "doc_id string, text string")
    assert sorted((r.doc_id, r.rule) for r in licences.scan(docs).collect()) == sorted((k, k) for k in MORE)


def test_sql_agrees_on_wrapped_notices(spark):
    texts = [*MORE.values(), *WRAPPED.values(), *(t.replace("\n", "\r\n") for t in WRAPPED.values()), "a license ...\n\n" + MIT.replace("\n\n", "\n") + ";;\x01 Released under\nthe MIT License!? Released under the MIT License", "." * 999 + " license\x01"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = sorted((r.doc_id, str(r.rule), str(r.licence), " ".join(map(str, r.sentence_ids))) for r in licences.scan(docs).collect())
    assert len(got) > 30 and got == sorted((a, str(b), str(c), d) for a, b, c, d in con.sql(licences.op6_sql()).fetchall())


def test_a_very_long_text_and_an_empty_table(spark):
    text = "plain words go on and on.\n" * 40_000 + "Released under the MIT license.\n" + "and on. " * 100_000
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, rule string")
    assert [r.licence for r in licences.scan(df).collect()] == [licences.scan(df.withColumn("text", F.lit("Released under the MIT license."))).first().licence]
    assert licences.scan(df.limit(0)).count() == 0
