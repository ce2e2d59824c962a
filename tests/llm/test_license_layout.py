"""Licenses in their standard layout, with blank lines between paragraphs."""

from tessera.llm import license_scan

BSD = """Copyright (c) 2020, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain.
"""


def test_standard_texts(spark, duck):
    whole = {label: text for label, text in reversed(license_scan.TEMPLATES)}
    # 24 of the 30 words of the BSD notice in one block, too few of either paragraph
    bsd = set(license_scan.words_of(whole["bsd"].encode()))
    first, second = (set(license_scan.words_of(t.encode())) for label, t in license_scan.TEMPLATES[11:] if label == "bsd")
    gone = [*sorted(first - second)[:4], *sorted(second - first)[:2]]
    rows = [(1, BSD), (2, UNLICENSE), (3, BSD.replace("\n\n", "\r\n \t\r\n")), (4, whole["bsd"]), (5, whole["unlicense"]), (6, b" ".join(sorted(bsd - set(gone))).decode()), (7, "free to use\n\nin any form"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "bsd", 2: "unlicense", 3: "bsd", 4: "bsd", 5: "unlicense", 6: "bsd", 7: "", 8: ""}
    assert got[1].score == got[2].score == got[3].score == 1.0
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = con.execute(license_scan.OP9_SQL)
    names = [d[0] for d in cursor.description]
    assert {r[names.index("doc_id")]: r[names.index("labels")] for r in cursor.fetchall()} == {i: r.labels for i, r in got.items()}
