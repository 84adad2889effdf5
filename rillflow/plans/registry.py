"""Names of operators, sources and functions, as flows write them. Nothing is imported by a name that is not listed."""

from __future__ import annotations

import inspect


def operators() -> dict:
    import rillflow.operators as ops
    from rillflow.functions import graph

    out = {n: getattr(ops, n) for n in dir(ops) if inspect.isclass(getattr(ops, n)) and not n.startswith("_")}
    for n, c in vars(ops.aggs).items():
        if inspect.isclass(c):
            out[f"aggs.{n}"] = c
    out |= {n: c for n, c in vars(graph).items() if inspect.isclass(c) and issubclass(c, ops.Op) and c is not ops.Op}
    from rillflow.operators import models

    out |= {n: c for n, c in vars(models).items() if inspect.isclass(c) and issubclass(c, ops.Op) and c is not ops.Op}
    return out | {f"{m}.{n}": c for n, c in list(out.items()) if "." not in n for m in ("wikidata", "matcher", "file", "model", "modelv2")}


def sources() -> dict:
    import rillflow.sources as src

    out = {n: getattr(src, n) for n in dir(src) if inspect.isclass(getattr(src, n)) and not n.startswith("_")}
    out["Function"] = src.FunctionSource
    out["TextBase"] = src.TextPlain
    return out | {f"{m}.{n}": c for n, c in list(out.items()) for m in ("text", "base", "file", "loader", "database")}


def functions() -> dict:
    from rillflow.functions import dates, domain, papers, strings, texts, values

    out = {}
    for module, places in ((domain, ("domain", "arxiv", "gestata.arxiv", "github", "gestata.github", "gdelt", "gestata.gdelt", "corenlu", "gestata.corenlu", "paper", "gestata.paper", "openapi", "gestata.openapi", "geo", "gestata.geo")), (dates, ("dates", "util.dates")), (papers, ("papers", "pdftext", "gestata.pdftext", "paper", "gestata.paper", "report_news1")), (values, ("values", "jsons", "util.jsons", "dicts", "util.dicts", "cc", "gestata.cc", "crawler", "gestata.crawler", "llm", "gestata.llm", "db_util", "doc_tree")), (strings, ("strings", "util", "util.strings", "util.urls", "urls", "digest", "gestata.digest", "util.types", "util.jsons", "clean", "polls", "gestata.polls", "files", "util.files")), (texts, ("texts", "util.split", "split", "markdown", "gestata.markdown", "html", "gestata.html", "nlp", "cnki", "gestata.cnki"))):
        for n, f in vars(module).items():
            if callable(f) and (getattr(f, "builds_column", False) or hasattr(f, "returns")):
                out[n] = f
                for p in places:
                    out[f"{p}.{n}"] = f
    for short in ("simple", "chinese", "recursive", "markdown", "char"):
        full = out[f"split_{short}"]
        for p in ("split", "util.split"):
            out[f"{p}.{short}"] = full
    for short in ("lower", "upper", "strip", "int", "float"):
        out[f"str.{short}"] = out[short] = out[f"f_{short}"]
    out["gestata.markdown.extract"] = out["markdown.extract"] = texts.markdown_extract
    return out


def function(name: str):
    """The function of a name, from the list."""
    known = functions()
    if name not in known:
        raise KeyError(f"no function is called {name}")
    return known[name]
