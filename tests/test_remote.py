import pytest
from pyspark.sql import types as T

from quern.functions import structure
from quern.sources import remote
from quern.sources.remote import Response

POLICY = {"a.org": ["/ok.*", "/next", "/loop.*", "/slow", "/big", "/long"], "b.org": ["/in"]}


def transport(answers, log):
    """A transport of recorded answers: lists are given one after the other, exceptions raised."""
    left = {u: list(a) if isinstance(a, list) else [a] for u, a in answers.items()}

    def get(url):
        log.append(url)
        a = left[url].pop(0) if len(left[url]) > 1 else left[url][0]
        if isinstance(a, Exception):
            raise a
        return a

    return get


@pytest.mark.parametrize(
    "url,answers,want,asked",
    [
        ("https://a.org/ok", {"https://a.org/ok": Response(200, {}, [b"x", b"y"])}, b"xy", 1),
        ("https://a.org/ok", {"https://a.org/ok": Response(302, {"location": "/next"}), "https://a.org/next": Response(200, {}, [b"n"])}, b"n", 2),
        ("https://a.org/ok", {"https://a.org/ok": Response(301, {"location": "https://b.org/in"}), "https://b.org/in": Response(200, {}, [b"b"])}, b"b", 2),
        ("https://a.org/ok", {"https://a.org/ok": Response(302, {"location": "https://evil.org/in"})}, "URL_POLICY", 1),
        ("https://a.org/ok", {"https://a.org/ok": Response(302, {"location": "http://a.org/ok"})}, "URL_POLICY", 1),
        ("https://a.org/ok", {"https://a.org/ok": Response(302)}, "REDIRECT_INVALID", 1),
        ("https://a.org/loop", {"https://a.org/loop": Response(302, {"location": "/loop"})}, "REDIRECT_LIMIT", 6),
        ("https://a.org/slow", {"https://a.org/slow": [Response(503), TimeoutError(), Response(200, {}, [b"s"])]}, b"s", 3),
        ("https://a.org/slow", {"https://a.org/slow": Response(503)}, "HTTP_STATUS", 3),
        ("https://a.org/slow", {"https://a.org/slow": TimeoutError()}, "CONNECT_TIMEOUT", 3),
        ("https://a.org/slow", {"https://a.org/slow": ConnectionError()}, "CONNECT_ERROR", 3),
        ("https://a.org/ok", {"https://a.org/ok": Response(404)}, "HTTP_STATUS", 1),
        ("https://a.org/big", {"https://a.org/big": Response(200, {"content-length": "99"}, [])}, "DOWNLOAD_LIMIT", 1),
        ("https://a.org/long", {"https://a.org/long": Response(200, {}, [b"12345", b"67890", b"!"])}, "DOWNLOAD_LIMIT", 1),
        ("https://a.org/no", {}, "URL_POLICY", 0),
        ("https://a.org/ok/%2e%2F", {}, "URL_POLICY", 0),
    ],
)
def test_fetch(url, answers, want, asked):
    log, waits = [], []
    try:
        got, final, way = remote.fetch(url, transport(answers, log), POLICY, most=10, wait=waits.append)
        assert final == log[-1] and way[0] == url
    except remote.Refused as e:
        got = str(e)
    assert got == want and len(log) == asked
    assert waits == [0.25, 0.5][: len(waits)]


def test_urls_as_a_table(rows):
    def answer(url):
        return Response(200, {}, [url.encode()]) if url.endswith("ok1") else Response(404)

    got = {r["url"]: (r["content"], r["code"]) for r in remote.fetched(rows("url string", ("https://a.org/ok1",), ("https://a.org/ok2",), ("http://a.org/ok1",)), answer, POLICY).collect()}
    assert got == {"https://a.org/ok1": (bytearray(b"https://a.org/ok1"), None), "https://a.org/ok2": (None, "HTTP_STATUS"), "http://a.org/ok1": (None, "URL_POLICY")}


def test_models_are_asked_again():
    said = iter([TimeoutError(), " ", ConnectionError(), "answer"])
    waits = []

    def model(prompt):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    assert remote.asked("p", model, wait=waits.append) == "answer" and waits == [3.0, 2.0, 12.0]

    def down(prompt):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        remote.asked("p", down, wait=waits.append)
    assert remote.asked("p", lambda p: "", tries=2, wait=waits.append) == ""


def test_embeddings_only_of_missing_keys(rows):
    def vector(texts):
        assert len(texts) <= 100 and all(len(t) <= 3000 for t in texts)
        return [[float(len(t))] for t in texts]

    texts = rows("key string, text string", ("a", "x"), ("b", "y" * 5000), ("b", "y" * 5000), ("c", None), *((f"k{i}", "zz") for i in range(250)))
    cache = rows("key string, embedding array<double>", ("a", [9.0]), ("old", [1.0]))
    got = {r["key"]: r["embedding"] for r in remote.embedded(texts, cache, vector).collect()}
    assert got == {"a": [9.0], "b": [3000.0], "c": [0.0], **{f"k{i}": [2.0] for i in range(250)}}


SHAPE = T.StructType().add("no", "long", False).add("steps", T.ArrayType(T.StructType().add("text", "string", False).add("unit", "string"), False), False)


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"no": 1, "steps": [{"text": "a", "unit": null}]}', []),
        ("{", [("$", "json_invalid")]),
        ("[]", [("$", "object_type")]),
        ('{"no": "1", "steps": []}', [("no", "int_type")]),
        ('{"no": true, "steps": {}}', [("no", "int_type"), ("steps", "list_type")]),
        ('{"steps": [{"unit": 5}], "secret name": 1}', [("no", "missing"), ("steps[0].text", "missing"), ("steps[0].unit", "string_type"), ("<extra_field>", "extra_forbidden")]),
    ],
)
def test_structured_errors(text, want):
    got = structure.errors(text, SHAPE)
    assert [(e["path"], e["type"]) for e in got] == want and "secret name" not in str(got)


def test_what_breaks_off_is_asked_for_again_and_never_ends_a_task(rows):
    tries = []

    def half():
        yield b"ab"
        if len(tries) < 3:
            raise ConnectionResetError

    def get(url):
        tries.append(url)
        return remote.Response(200, {}, half())

    policy = {"a.org": [".*"]}
    assert remote.fetch("https://a.org/x", get, policy, wait=lambda s: None)[0] == b"ab" and len(tries) == 3

    def broken(url):
        if url.endswith("value"):
            raise ValueError("x")

        def body():
            yield b"a"
            raise ConnectionResetError

        return remote.Response(200, {}, body())

    got = remote.fetched(rows("url string", ("https://a.org/value",), ("https://a.org/reset",)), broken, policy, retries=0).collect()
    assert {r["url"][-5:]: r["code"] for r in got} == {"value": "TRANSPORT_ValueError", "reset": "CONNECT_ERROR"}


def test_embedding_faults_are_values(rows):
    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0]] * (len(texts) if "few" not in texts else 0)

    cache = rows("key string, embedding array<double>", ("k", [2.0]))
    for text, code in (("bad", "EMBEDDING_ValueError"), ("few", "EMBEDDING_ValueError"), ("good", None)):
        got = {r["key"]: (r["embedding"], r["code"]) for r in remote.embedded(rows("key string, text string", ("k", "x"), ("n", text)), cache, embed).collect()}
        assert got == {"k": ([2.0], None), "n": (None if code else [1.0], code)}
