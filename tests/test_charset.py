"""Character sets of responses against a table of cases."""

import pytest

from webloom.functions.charset import decoded, to_text

CASES = [
    ("é".encode(), None, "é"),
    ("é".encode("latin-1"), 'text/html; charset="ISO-8859-1"', "é"),
    (b"\x93a\x94", "text/html;charset=latin1", "“a”"),
    (b'<meta charset="koi8-r">' + "да".encode("koi8-r"), "text/html", '<meta charset="koi8-r">да'),
    (b"<meta http-equiv='Content-Type' content='text/html; charset=shift_jis'>" + "日".encode("shift_jis"), "", "<meta http-equiv='Content-Type' content='text/html; charset=shift_jis'>日"),
    (b" " * 1024 + b'<meta charset="koi8-r">\xc4', None, " " * 1024 + '<meta charset="koi8-r">�'),
    (b"x", "text/html; charset=no-such-set", None),
    (b"", None, ""),
    (None, "text/html", None),
]


@pytest.mark.parametrize(("body", "content_type", "want"), CASES)
def test_to_text(body, content_type, want):
    assert to_text(body, content_type) == want


def test_decoded(spark):
    df = spark.createDataFrame([(k, "u", b, c) for k, (b, c, _) in enumerate(CASES)], "page_id long, url string, body binary, content_type string")
    assert {r.page_id: r.html for r in decoded(df).collect()} == {k: w for k, (_, _, w) in enumerate(CASES)}
    assert decoded(df.limit(0)).count() == 0
