"""Column functions against small tables of expected values."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import address as A
from quillmill.functions import names as N
from quillmill.functions import text as T


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_addresses(spark):
    headers = ["Ann <Ann@X.org>", "bob@x.org, cy@x.org", "nobody", "", None, "a <not> b@c.d"]
    assert values(spark, headers, A.address) == ["ann@x.org", "bob@x.org", "", "", "", "b@c.d"]
    assert values(spark, ["a@b@c.org", "x", ""], A.domain) == ["c.org", "", ""]
    assert values(spark, ["a@b@c.org", "x", ""], A.local_part) == ["a@b", "", ""]
    assert values(spark, ['"Ann B" <a@b.c>', "Ann <a@b.c>", "a@b.c", None, "'Z' <z@z.z>"], A.sender_display) == ["Ann B", "Ann", "", "", "Z"]
    assert values(spark, ["Mail x.y+z@A-b.co. and É@ä.de x@y.z", None], A.addresses_in) == [["x.y+z@a-b.co.", "x@y.z", "é@ä.de"], []]
    assert values(spark, ["jana.smith@gmail.com", "jana@x", "._@x"], A.name_of_address) == ["Jana Smith", "Jana", "._@x"]


@pytest.mark.parametrize(
    "sender,bulk",
    [
        ("noreply@shop.com", True), ("No-Reply <no-reply+x@shop.com>", True), ("info-team@shop.com", True), ("hello.kitty@shop.com", True), ("infomercial@shop.com", False), ("team@gmail.com", False),
        ("noreply@gmail.com", True), ("ann@news.substack.com", True), ("ann@substack.com", True), ("ann@redditads.com", True), ("calendar-notification@google.com", False), ("calendar@evil.com", False),
        ("ann@corp.com", False), (None, False), ("", False), ("Mailer-Daemon@corp.com", True), ("a@mail.salesforce.com", True), ("a@salesforce.com", False),
    ],
)
def test_bulk_sender(spark, sender, bulk):
    assert values(spark, [sender], A.is_bulk_sender) == [bulk]


def test_bulk_message(spark):
    rows = [
        ("ann@corp.com", {"LIST-ID": "<x>"}, True), ("ann@corp.com", {"List-Id": "  "}, False), ("ann@corp.com", {"precedence": " Junk "}, True), ("ann@corp.com", {"Auto-Submitted": "no"}, False),
        ("ann@corp.com", {"auto-submitted": "auto-generated"}, True), ("ann@corp.com", {"List-Unsubscribe": "<y>"}, False), ("ann@gmail.com", {"List-Id": "<x>"}, False), ("me@own.org", {"List-Id": "<x>"}, False),
        ("calendar-noreply@google.com", {"Precedence": "bulk"}, False), (None, None, False), (None, {"Precedence": "list"}, True),
    ]
    df = spark.createDataFrame(rows, "s string, h map<string,string>, e boolean")
    assert [(r[0], r[1]) for r in df.select("e", A.is_bulk_message(F.col("h"), F.col("s"), ["Me <me@own.org>"])).collect()] == [(e, e) for _, _, e in rows]


def test_inline_images(spark):
    got = values(spark, ["image001.png@01d9", "image@x.org", "image2_a@x", "part1.02@x", "a.jpeg@x", "ann@0123456789.abcdef01", "ann@x.org", "x"], A.is_inline_image)
    assert got == [True, False, True, True, True, True, False, False]


def test_names(spark):
    raw = ["Dr. Smith", "Aunt Carol", "Ryan Rigney Marketing", "mom", "Sam Lee CEO Founder", "Founder", "'Ann B.'", "", None, "Jane Smith Jr."]
    assert values(spark, raw, N.clean_person) == ["Smith", "Carol", "Ryan Rigney", "", "Sam Lee", "Founder", "Ann B", "", "", "Jane Smith Jr"]
    names = ["Clinton St", "Edge Esmeralda", "Jane Trumpington", "IBM", "Coinbase Wealth", "Park", "Ann2", "ann", "Acme Labs", "A", "", None, "Best Regards", "Trump", "Anna Cloud", "Jane Smith", "École"]
    assert values(spark, names, N.is_rejected) == [True, True, False, True, True, False, True, True, True, True, True, True, True, True, True, False, False]
    given = ["Mitra Mitra Martin", "Kelly Ebeling Founder/CEO Intro", "Branson Bollinger Wagmi Intro Call", "Founder", "", None]
    assert values(spark, given, N.normalise) == ["Mitra Martin", "Kelly Ebeling", "Branson Bollinger Wagmi", "Founder", "", None]
    assert values(spark, ["Jane Smith!", "--", None], N.slug) == ["jane-smith", "unknown", "unknown"]
    assert values(spark, ["Ann B", "ann b", "Ann", "Ann B C D E", "Ann B2"], N.looks_personal) == [True, False, False, False, False]


def test_title_names(spark):
    got = values(spark, ["Mom's anniversary", "Jana's birthday", "Family Dinner with Vitus", "Dinner at Joe's", "Standup", None, "Ida's and Ida's party"], N.names_in_title)
    assert [[(x["name"], x["detector"]) for x in g] for g in got] == [[], [("Jana", "possessive_in_title")], [("Vitus", "kinship_adjacent")], [("Joe", "possessive_in_title")], [], [], [("Ida", "possessive_in_title")]]


def test_self_rules(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "x", "b"], ["a", "b"]), (["a", "c"], ["a"]), (["a"], ["a", "c"]), (["b"], ["a"]), ([], ["a"])], "c array<string>, a array<string>")
    assert [r[0] for r in df.select(N.matches_alias(F.col("c"), F.col("a"))).collect()] == ["exact", "first+last", "first-name", "first-name", "", ""]


def test_clean_html(spark):
    html = [
        "<p>Hello, <i>world</i></p>", "<style>p{color:red}</style><script>x()</script>Hello", "I like Helvetica and Arial.", "a\n\n\n\n\nb", "", None, "x font-size: 12px; y #a1b2c3 z rgb(1, 2, 3)", "Hi\nUnsubscribe\nthere", "a &amp; b&nbsp;c",
        "<p>see #section and #12345 here</p>", "margin-left: 3px;\nmine: yes;\nText: stays",
    ]
    assert values(spark, html, T.clean_html) == ["Hello, world", "Hello", "I like Helvetica and Arial.", "a\n\nb", "", "", "x y z", "Hi\n\nthere", "a & b\xa0c", "see #section and #12345 here", "Text: stays"]


def test_quotes(spark):
    mails = ["Yes.\n\nOn Mon, Jan 1 Ann wrote:\n> old", "Yes\n> a\n  > b\nmore", "Ok\nSent from my iPhone 15", "Le lundi Ann a écrit :\nx", "a\n---- Forwarded message ----\nb", None, "On the way", "Am Montag schrieb Ann:\nx", "ok\nGet Outlook for iOS"]
    assert values(spark, mails, T.without_quotes) == ["Yes.", "Yes\nmore", "Ok", "", "a", "", "On the way", "", "ok"]


def test_sentences(spark):
    text = "One. Then Nora came home! Three"
    assert values(spark, [text, None, "x" * 300 + " Nora", "No one. Leonora was here"], lambda c: T.sentence_around(c, F.lit("nora"))) == ["Then Nora came home!", "", "x" * 220 + "...", "No one. Leonora was here"]
    assert values(spark, ["a+b is (c)"], lambda c: T.sentence_around(c, F.lit("(c"))) == ["a+b is (c)"]


def test_small_things(spark):
    assert values(spark, ["b A or a", None], T.token_bag) == [["a", "b", "or"], []]
    assert values(spark, ["Accepted: Vitus Birthday @ Thu May 28, 2026 9:30am", "Updated invitation: X", "plain", None], T.event_title) == ["Vitus Birthday", "X", "plain", ""]
    assert values(spark, ['{"a":1}', 'say {"a": 2} ok', "none", "{bad}"], T.json_object) == ['{"a":1}', '{"a": 2}', None, None]
    ratio = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(T.sequence_ratio("a", "b")).collect()
    assert [r[0] for r in ratio] == [0.75, None]
    hours = spark.createDataFrame([(0.5,), (5.0,), (31.0,), (200.0,)], "h double")
    assert [tuple(r) for r in hours.select(T.freshness(F.col("h")), T.age(F.col("h"))).collect()] == [("FRESH", "30m ago"), ("FRESH", "5.0h ago"), ("STALE", "1.3d ago"), ("OLD", "8.3d ago")]
    assert values(spark, ["Accepted: x", "hello"], lambda c: T.is_calendar_reply(c, F.lit("see calendar.google.com/calendar/r"))) == [True, False]
    vec = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in vec.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.6, 0.0, 0.0]
