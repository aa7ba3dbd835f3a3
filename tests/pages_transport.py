"""A transport that workers import: it answers by the url."""

from quern.sources.remote import Response


def get(url):
    if url.endswith("missing"):
        return Response(404)
    if url.endswith("fault"):
        raise KeyError("x")
    if url.endswith("moved"):
        return Response(301, {"location": "/1"})
    return Response(200, {}, [b"page ", url.encode()])
