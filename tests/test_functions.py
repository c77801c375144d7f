import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siteloom.functions import colors, labels, network, urls


def values(spark, rows, schema, *columns):
    """The columns over literal rows, in order of the first field."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_n int, {schema}")
    return [tuple(x)[1:] for x in df.select("_n", *columns).orderBy("_n").collect()]


def test_url_keys(spark):
    token = "a1B2c3D4e5F6g7H8"
    rows = [("https://www.App.com/Path/?q=1#x",), ("http://a.com//",), ("a.com/orders/" + token,), (token,), ("https://a.com/longlowercaseword",)]
    got = values(spark, rows, "u string", urls.clean_url(F.col("u")), urls.route_shape(F.col("u")), urls.slugify(F.col("u")))
    assert [x[0] for x in got] == ["App.com/Path/?q=1", "a.com", "a.com/orders/" + token, token, "a.com/longlowercaseword"]
    assert [x[1] for x in got] == ["App.com/Path/?q=1", "a.com", "a.com/orders/{token}", token, "a.com/longlowercaseword"]
    assert got[0][2] == "www.App.com_Path_?q=1#x"


def test_scope(spark):
    rows = [("http://a.com/x", "a.com"), ("b.a.com", "a.com"), ("b.com", "a.com"), ("", "a.com"), ("localhost", "a.com")]
    both = (urls.is_in_scope(F.col("u"), F.col("b")), urls.is_in_scope(F.col("u"), F.col("b"), True))
    got = values(spark, rows, "u string, b string", *both)
    assert got == [(True, True), (False, True), (False, False), (True, True), (False, False)]


def test_resolve_href(spark):
    base = "https://h.com/a/b.html?q#f"
    cases = {
        "c": "https://h.com/a/c", "../c?x=1": "https://h.com/c?x=1", "/d/./e/": "https://h.com/d/e/", "//o.com/p": "https://o.com/p", "?z": "https://h.com/a/b.html?z",
        "http://x.com": "http://x.com", "#top": None, "": None, " ": None, "mailto:a@b.c": None, "javascript:void(0)": None, "../../../f": "https://h.com/f",
    }
    got = values(spark, [(x, base) for x in cases], "h string, b string", urls.resolve_href(F.col("b"), F.col("h")))
    assert [x[0] for x in got] == list(cases.values())


def test_path_patterns(spark):
    t = "8d206b72aaaa4c1f9b0e"
    got = values(spark, [(f"/orders/{t}/items/{t}/",), ("/",), ("/plain/path",)], "p string", urls.path_pattern(F.col("p")), urls.path_params(F.col("p")))
    assert got == [("/orders/{id}/items/{id_2}", ["id", "id_2"]), ("/", []), ("/plain/path", [])]
    got = values(spark, [("/orders/{id}/orders/{id}",), ("/{id}",), ("/api/boxes/{id}",), ("/class/{id}",), ("/bus/{id}/ads/{id}",)], "p string", labels.path_template(F.col("p")))
    assert [x[0] for x in got] == ["/orders/{orderId}/orders/{orderId2}", "/{id}", "/api/boxes/{boxeId}", "/class/{clasId}", "/bus/{busId}/ads/{adsId}"]


def test_request_parts(spark):
    rows = [("https://x.io/rest/v1?b=2&a=1&a=3&c",), ("https://x.io",)]
    u = F.col("u")
    got = values(spark, rows, "u string", urls.request_host(u), urls.request_path(u), urls.query_names(u))
    assert got == [("x.io", "/rest/v1", ["a", "b"]), ("x.io", "/", [])]


def test_headers(spark):
    rows = [({"Authorization": "Bearer abc"},), ({"X-Api-Key": "1", "Cookie": "c"},), ({"Cookie": "c"},), ({"Content-Type": "Text/HTML; x"},), (None,)]
    h = F.col("h")
    got = values(spark, rows, "h map<string,string>", network.auth_scheme(h), network.media_type(h))
    assert got == [("bearer", ""), ("header:x-api-key", ""), ("cookie", ""), ("", "text/html"), ("", "")]
    kept = values(spark, rows[:2], "h map<string,string>", network.redact_headers(h))
    assert kept[0][0] == {"Authorization": "[REDACTED]"} and kept[1][0] == {"X-Api-Key": "1", "Cookie": "[REDACTED]"}


def test_redaction(spark):
    rows = [("mail a.b@c.org, card 4111 1111 1111 1111, x",), ("t " + "a1" * 20,), ("",), (None,)]
    got = values(spark, rows, "t string", network.redact_text(F.col("t")))
    assert got[0][0] == "mail [REDACTED], card [REDACTED], x" and got[1][0] == "t [REDACTED]" and got[2:] == [("",), (None,)]
    body = json.dumps({"user": {"password": "x", "name": "n"}, "list": [{"apiKey": [1]}, "a@b.co"], "n": 1})
    got = values(spark, [(body,), ("plain a@b.co",), (None,)], "t string", network.redact_body(F.col("t")))
    assert json.loads(got[0][0]) == {"user": {"password": "[REDACTED]", "name": "n"}, "list": [{"apiKey": "[REDACTED]"}, "[REDACTED]"], "n": 1}
    assert got[1:] == [("plain [REDACTED]",), ("",)]
    deep = json.dumps({"a": [{"token": {"x": [1, "a@b.co"]}, "k\"ey: ,": "v, ]}"}, [], {}, "card 4111111111111111"], "n": None, "é": "\u00e9"})
    got = values(spark, [(deep,), ('"a@b.co"',), ("[" * 5000 + "]" * 5000,)], "t string", network.redact_body(F.col("t")))
    want = {"a": [{"token": "[REDACTED]", "k\"ey: ,": "v, ]}"}, [], {}, "card [REDACTED]"], "n": None, "é": "\u00e9"}
    assert json.loads(got[0][0]) == want and got[1][0] == '"[REDACTED]"'


def test_shapes_and_excerpts(spark):
    rows = [('{"a": 1, "b": [true, 2], "c": null, "d": {}}',), ("[]",), ("no json",), (None,)]
    got = values(spark, rows, "t string", network.json_shape(F.col("t")))
    assert json.loads(got[0][0]) == {"a": "number", "b": ["boolean"], "c": "null", "d": {}} and got[1:] == [("[]",), ("",), ("",)]
    rows = [('[[{"a": [1, {"b": 2}]}, 3], "x"]',), ('{"a": {"b": [], "c": [[1, 2], [3]]}, "d": -1e5}',), ("5",)]
    got = [json.loads(x[0]) for x in values(spark, rows, "t string", network.json_shape(F.col("t")))]
    assert got == [[[{"a": ["number"]}]], {"a": {"b": [], "c": [["number"]]}, "d": "number"}, "number"]
    long = "é" * 5000
    kept = network.truncate_and_hash(F.col("t"))
    got = values(spark, [(long,)], "t string", kept)[0][0]
    assert got.excerpt == "é" * 4096 and got.length == 10000
    body = '{"password": "hunter2", "note": "of a@b.co", "n": 1, "n": 1.50}'
    got = values(spark, [(body,), ("",), (None,)], "t string", kept)
    clean = '{"password": "[REDACTED]", "note": "of [REDACTED]", "n": 1.5}'
    assert tuple(got[0][0]) == (clean, len(body), hashlib.sha256(clean.encode()).hexdigest())
    assert [tuple(x[0]) for x in got[1:]] == [("", 0, "")] * 2
    got = values(spark, [('{"a": 1, "b": [], "a": "x"}',)], "t string", network.json_shape(F.col("t")))
    assert got == [('{"a": "string", "b": []}',)]
    assert values(spark, [(1.0, 1.5), (2.0, 1.0), (None, 1.0)], "a double, b double", network.latency_ms(F.col("a"), F.col("b"))) == [(500,), (None,), (None,)]


def test_colors(spark):
    rows = [("rgb(45, 119, 55)",), ("rgba(0, 0, 0, 0)",), ("rgba(1, 2, 3, 0.5)",), ("red",)]
    got = [x[0] and tuple(x[0]) for x in values(spark, rows, "c string", colors.parse_css_color(F.col("c")))]
    assert got == [(45, 119, 55), None, (1, 2, 3), None]
    lab = colors.to_lab(F.col("r"), F.col("g"), F.col("b"))
    got = values(spark, [(255, 255, 255), (0, 0, 0), (255, 0, 0)], "r int, g int, b int", lab, colors.to_hex(F.col("r"), F.col("g"), F.col("b")))
    assert got[0][0].l == pytest.approx(100, abs=0.01) and got[1][0].l == pytest.approx(0, abs=0.01)
    assert (got[2][0].l, got[2][0].a) == (pytest.approx(53.24, abs=0.05), pytest.approx(80.09, abs=0.1)) and got[2][1] == "#ff0000"


def test_component_types_and_names(spark):
    rows = [("input", "", "email", ""), ("button", "", "submit", ""), ("div", "menuitem", "", ""), ("div", "", "", "pointer"), ("a", None, None, None)]
    kind = labels.component_type(*(F.col(x) for x in "tril"))
    got = values(spark, rows, "t string, r string, i string, l string", kind, labels.component_name(kind))
    assert [x[1] for x in got] == ["TextFieldEmail", "SubmitButton", "ListMenuOption", "CustomControl", "Link"]


def test_operation_names(spark):
    rows = [("POST", False, "/orders/{orderId}/items"), ("GET", True, "/orders"), ("DELETE", False, "/orders/{orderId}"), ("GET", False, "/")]
    named = labels.operation(F.col("m"), F.col("q"), F.col("p"))
    got = values(spark, rows, "m string, q boolean, p string", named["operation_id"], named["summary"])
    assert got == [("createItem", "Create item"), ("listOrders", "List orders"), ("deleteOrder", "Delete order"), ("getRoot", "Get root")]
    got = [tuple(x[0]) for x in values(spark, [("header:x-api-key",), ("cookie",), ("bearer",)], "s string", labels.security_scheme(F.col("s")))]
    assert got == [("xApiKey", "apiKey", "header", "x-api-key"), ("sessionCookie", "apiKey", "cookie", "session"), ("bearerAuth", "http", None, "bearer")]


def test_field_rules(spark):
    rows = [("Correo electrónico", "text", True), ("fecha", "date", False), ("x", "", None)]
    got = values(spark, rows, "n string, i string, r boolean", labels.expected_input(F.col("n")), labels.data_type(F.col("i")), labels.validation(F.col("i"), F.col("r")))
    assert got == [("email", "string", "required"), ("date", "date", "type=date"), (None, "string", "")]
    got = values(spark, [("form#login", "a.com/x"), ("", "a.com/sign-up/"), (None, None)], "f string, p string", labels.entity_name(F.col("f"), F.col("p")))
    assert got == [("login",), ("sign-up form",), ("form",)]
    got = values(spark, [("12,5",), ("+",), ("a1",), (None,)], "t string", labels.looks_numeric(F.col("t")), labels.fold_accents(F.col("t")))
    assert [x[0] for x in got] == [True, False, False, False]
    assert values(spark, [("a > b > c",), ("a",)], "p string", labels.parent_path(F.col("p"))) == [("a > b",), ("",)]


def test_excerpts_end_before_a_character_that_the_cut_would_split(spark):
    most = network.EXCERPT_BYTES
    given = ["a" * (most - k) + c * 3 for c in ("é", "€", "🙂") for k in range(5)] + ["b" * most]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    plan = rows.select("i", network.byte_excerpt(F.col("text")).alias("x"))
    assert [x.x for x in plan.orderBy("i").collect()] == [x.encode()[:most].decode(errors="ignore") for x in given]
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_pages_are_parsed_a_few_at_a_time():
    import pyarrow as pa

    from siteloom.sources import html

    batch = pa.record_batch({"page_id": list(range(250)), "url": ["u"] * 250, "html": ["<a href=x>y</a>"] * 250})
    made = list(html._parse(("links",))(iter([batch])))
    assert [len(x) for x in made] == [100, 100, 50]
    assert [x for y in made for x in y["page_id"].to_pylist()] == list(range(250))
