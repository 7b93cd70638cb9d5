"""Known licence texts are found however their lines are wrapped."""

import re
import textwrap

import pytest

from seqloom.llm import licenses

HEADER = re.compile(r"(?i)^\W*copyright\W*\(c\)")


def wrapped(text, width):
    """Paragraphs filled anew; copyright lines stay lines of their own."""
    out = []
    for part in re.split(r"\n\s*\n", text):
        run = []
        for line in [*part.split("\n"), None]:
            if line is None or HEADER.match(line):
                out += [textwrap.fill(" ".join(run), width, break_long_words=False, break_on_hyphens=False), line or ""]
                run = []
            else:
                run.append(line.strip())
        out.append("")
    return "\n".join(out)


def test_known_texts_at_many_widths(spark):
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.ALL):
        for width in (None, 40, 50, *range(60, 81, 2), 100):
            key = f"{k} {width}"
            want[key] = name
            rows.append((key, "Copyright (c) 2020 Someone\n\n" + (text if width is None else wrapped(text, width))))
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.license, want[r.doc_id]) for r in got if r.license != want[r.doc_id]] == []


@pytest.mark.parametrize("line", ["Copyright (c) Someone", "Copyright 2020 Someone", "(c) 2019 A", "© 2001 A", "# Copyright The Foo Authors, 2020", "COPYRIGHT © A", "Copyright: 1999-2003 A"])
def test_copyright_lines_go(spark, line):
    row = licenses.license_scan(spark.createDataFrame([(1, line + "\n" + licenses._ISC)], "doc_id int, text string")).first()
    assert row.license == "ISC"


def test_every_common_licence_is_listed():
    assert {n for n, _ in licenses.ALL} >= {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
