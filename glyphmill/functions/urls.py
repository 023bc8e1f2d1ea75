"""URL expressions. All are native columns; absolute http(s) URLs are taken apart by pattern.

An address that isn't http(s) has null parts, and predicates on it are false.
Relative references are resolved by ``resolve``, the one Arrow UDF here.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that must equal the reference's for right results.
KEYWORDS = ["foundation", "token", "component", "pattern", "accessib", "guideline", "resource", "changelog", "storybook", "story", "agent"]
TRACKING = r"(?i)^(utm_\w+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|ref_src|_ga|_gl)$"
SECTIONS = [
    "components", "component", "componentes", "componente", "foundations", "foundation", "fundamentos", "fundamentals", "tokens", "design-tokens",
    "patterns", "pattern", "patrones", "guidelines", "guias", "guías", "pautas", "elements", "elementos", "styles", "estilos", "getting-started",
    "get-started", "primeros-pasos", "resources", "recursos", "templates", "plantillas", "layouts", "accessibility", "accesibilidad", "changelog",
    "releases", "release-notes", "docs", "documentation", "documentacion", "documentación",
]
TABS = [
    "usage", "style", "code", "accessibility", "examples", "api", "props", "design", "guidelines", "overview", "specs", "spec", "specifications",
    "uso", "estilo", "codigo", "código", "accesibilidad", "ejemplos", "diseno", "diseño", "especificaciones",
]
TAB_ORDER = [
    "usage", "uso", "overview", "guidelines", "design", "diseno", "diseño", "style", "estilo", "specs", "spec", "specifications", "especificaciones",
    "examples", "ejemplos", "code", "codigo", "código", "api", "props", "accessibility", "accesibilidad",
]
GENERIC = ["", "index", "overview", "components", "guidelines", "getting-started", "web", "react", "ios", "android", "windows"]
NOT_DESIGN = r"(^|[/_-])(mcp|llms?|ai|auth|oauth|access|bearer|jwt|csrf|session|prompts?)([/_-]|$)"
FOUNDATION = (
    "foundations?|fundamentos|colou?rs?|spacing|espaciado|typography|tipograf|elevation|elevaci|motion|movimiento|themes?|temas?|radius|shadows?|sombras?"
)
CORE_SEGMENT = "^(colou?rs?|colores|spacing|espaciado|typography|tipograf[ií]a|type|themes?|temas?)$"
CORE_WORD = "colou?rs?|colores|spacing|espaciado|typography|tipograf|themes?|temas?"
STYLE_WORD = "elevation|elevaci|motion|movimiento|radius|radio|shadows?|sombras?|shape|forma|layout|grid|breakpoints?|sizing|size"
ASSET = r"\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|mp4|woff2?|ttf|css|js)$"
CHANGELOG = r"changelog|release-notes|/releases?(/|$)|whats-new|novedades|historial-de-cambios"
PATTERN = r"/(patterns?|patrones?|templates?|plantillas?|recipes?)(/|$)"
PATTERN_INDEX = "^(patterns?|patrones?|templates?|plantillas?|recipes?|overview|index)$"
UTILITY = [r"(^|/)(robots\.txt|llms\.txt|agents\.md|humans\.txt|security\.txt)$", r"(^|/)sitemap[^/]*\.xml$", r"(^|/)(index|stories)\.json$"]
RESERVED_OWNERS = ["sponsors", "orgs", "features", "topics", "about", "login"]

_URL = r"(?i)^(https?)://([^/?#:]*)(:\d+)?([^?#]*)(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.when(url.rlike(r"(?i)^https?://[^/?#:\s]+"), F.regexp_extract(url, _URL, group))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def origin(url: Column) -> Column:
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url), _part(url, 3))


def path(url: Column) -> Column:
    p = _part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(path(url), F.lit("")), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    s = segments(url)
    return F.when(F.size(s) > 0, F.lower(F.element_at(s, -1))).otherwise("")


def path_to_name(url: Column) -> Column:
    s = segments(url)
    return F.when(F.size(s) > 0, F.element_at(s, -1)).otherwise(url)


def component_identity(url: Column) -> Column:
    """The last segment, or the one before it where the last names a tab; the URL itself without segments."""
    s = segments(url)
    last = F.lower(F.try_element_at(s, F.lit(-1)))
    return F.when((F.size(s) >= 2) & last.isin(TABS), F.lower(F.try_element_at(s, F.lit(-2)))).otherwise(F.coalesce(last, url))


def is_component_page(url: Column) -> Column:
    p = F.coalesce(path(url), F.lit(""))
    s = segments(url)
    slug = F.coalesce(F.lower(F.try_element_at(s, F.lit(-1))), F.lit(""))
    parent = F.coalesce(F.lower(F.try_element_at(s, F.lit(-2))), F.lit(""))
    tab = slug.isin(TABS) & (parent != "") & ~parent.rlike("^components?$|^componentes?$") & ~parent.isin(GENERIC)
    return (p.rlike(r"(?i)/components?/") | p.rlike(r"(?i)/react-[a-z0-9-]+/?$")) & (~slug.isin(GENERIC) | tab)


def _low(url: Column) -> Column:
    return F.lower(path(url))


def is_design_token(url: Column) -> Column:
    p = _low(url)
    return F.coalesce(p.rlike("tokens?") & ~p.rlike(NOT_DESIGN), F.lit(False))


def classify(url: Column) -> Column:
    p = _low(url)
    return (
        F.when(p.isNull(), "other")
        .when(p.rlike(ASSET), "asset")
        .when(p.rlike(CHANGELOG), "changelog")
        .when(is_component_page(url), "component")
        .when(p.rlike(PATTERN), F.when(last_segment(url).rlike(PATTERN_INDEX), "pattern_index").otherwise("pattern"))
        .when(p.rlike(FOUNDATION) | is_design_token(url), "tokens")
        .otherwise("other")
    )


def token_page_rank(url: Column) -> Column:
    p = _low(url)
    core = F.exists(segments(url), lambda s: F.lower(s).rlike(CORE_SEGMENT))
    return F.when(p.isNull(), 9).when(is_design_token(url), 0).when(core, 1).when(p.rlike(CORE_WORD), 2).when(p.rlike(STYLE_WORD), 3).otherwise(4)


def ds_root(url: Column) -> Column:
    """Origin and path before the first section segment; without one, the directory."""
    s = segments(url)
    ends = F.transform(s, lambda x: F.lower(F.coalesce(F.try_url_decode(x), x)).isin(SECTIONS) | F.lower(x).rlike("^react-[a-z0-9-]+$"))
    at = F.array_position(ends, F.lit(True))
    file = (F.size(s) > 0) & F.coalesce(F.try_element_at(s, F.lit(-1)).rlike(r"(?i)\.[a-z0-9]{2,5}$"), F.lit(False))
    n = F.when(at > 0, at - 1).otherwise(F.size(s) - file.cast("int")).cast("int")
    kept = F.slice(s, F.lit(1), n)
    return F.when(path(url).isNotNull(), F.concat(origin(url), F.lit("/"), F.array_join(kept, "/"), F.when(n > 0, "/").otherwise("")))


def query_pairs(url: Column) -> Column:
    """array of (key, n, value) of the query string."""
    raw = F.regexp_replace(F.coalesce(_part(url, 5), F.lit("")), r"^\?", "")
    parts = F.filter(F.split(raw, "&"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x, n: F.struct(F.substring_index(x, "=", 1).alias("key"), n.alias("n"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("value")),
    )


def normalize(url: Column) -> Column:
    """One form a page: entities decoded, no fragment or tracking parameters, parameters sorted by key, stable."""
    u = F.replace(F.replace(F.trim(url), F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
    kept = F.array_sort(F.filter(query_pairs(u), lambda q: ~q["key"].rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda q: F.concat(q["key"], F.lit("="), q["value"])), "&")
    return F.when(path(u).isNotNull(), F.concat(origin(u), path(u), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def in_root(url: Column, root: Column) -> Column:
    return same_host(url, root) & F.coalesce(F.startswith(_low(url), _low(root)), F.lit(False))


def in_scope(url: Column, entry: Column, allowed: list[str] | None = None) -> Column:
    if allowed:
        ok = F.lit(False)
        for p in allowed:
            ok = ok | F.startswith(path(url), F.lit(p))
    else:
        ok = F.startswith(_low(url), _low(entry))
        for word in KEYWORDS:
            ok = ok | F.contains(_low(url), F.lit(word))
    return same_host(url, entry) & F.coalesce(ok, F.lit(False))


def is_utility(url: Column) -> Column:
    p = _low(url)
    return F.coalesce(p.rlike(UTILITY[0]) | p.rlike(UTILITY[1]) | p.rlike(UTILITY[2]), F.lit(False))


def is_token_tab(link: Column, page: Column) -> Column:
    """A link to /tokens beside or below a page's path."""
    base = F.regexp_replace(_low(page), "/+$", "")
    parent = F.regexp_replace(base, "/[^/]*$", "")
    target = F.regexp_replace(_low(link), "/+$", "")
    return same_host(link, page) & F.coalesce((target == F.concat(base, F.lit("/tokens"))) | (target == F.concat(parent, F.lit("/tokens"))), F.lit(False))


def official_kind(url: Column) -> Column:
    story = F.coalesce(F.try_url_decode(F.regexp_extract(F.coalesce(_part(url, 5), F.lit("")), r"[?&]path=([^&]*)", 1)), F.lit(""))
    h, p, s = host(url), path(url), segments(url)
    book = h.rlike(r"(^|\.)storybook\b|storybook\.") | p.rlike(r"(?i)/storybook(/|$)") | story.rlike(r"(?i)^/(story|docs)/")
    repo = (h == "github.com") & (F.size(s) >= 2) & ~F.lower(F.try_element_at(s, F.lit(1))).isin(RESERVED_OWNERS)
    return F.when(h.isNull(), None).when(book, "storybook").when(repo, "repository").when(h.isin("npmjs.com", "www.npmjs.com") & p.rlike("^/package/"), "package")


def official_key(url: Column, kind: Column) -> Column:
    s, p = segments(url), path(url)
    package = F.regexp_extract(p, "^/package/((?:@[^/]+/)?[^/]+)", 1)
    repo = F.concat(F.lit("https://github.com/"), F.try_element_at(s, F.lit(1)), F.lit("/"), F.regexp_replace(F.try_element_at(s, F.lit(2)), r"\.git$", ""))
    return (
        F.when(kind == "repository", repo)
        .when(kind == "package", F.when(package != "", F.concat(F.lit("https://www.npmjs.com/package/"), package)).otherwise(url))
        .when(kind == "storybook", F.concat(origin(url), F.regexp_extract(p, "(?i)^(.*?/storybook)(/|$)", 1)))
        .otherwise(url)
    )


def storybook_candidates(url: Column) -> Column:
    base = F.concat(origin(url), F.regexp_replace(path(url), "/+$", ""), F.lit("/"))
    top = F.concat(origin(url), F.lit("/"))
    return F.array_distinct(F.array(*[F.concat(b, F.lit(f)) for b in (base, top) for f in ("index.json", "stories.json")]))


def label_kind(label: Column) -> Column:
    words = F.lower(F.coalesce(label, F.lit("")))
    return F.when(words.rlike("storybook"), "storybook").when(words.rlike(r"\b(github|gitlab|repository|repositorio|source code|c[oó]digo fuente)\b"), "repository").when(words.rlike(r"\b(npm|package|paquete)\b"), "package")


def resolve(raw: Column, base: Column) -> Column:
    """A reference against a base URL, by an Arrow UDF; null for what isn't http(s)."""
    def run(raws: pa.Array, bases: pa.Array) -> pa.Array:
        from urllib.parse import urljoin, urlsplit

        out = []
        for r, b in zip(raws.to_pylist(), bases.to_pylist(), strict=True):
            try:
                u = urljoin(b or "", (r or "").strip().replace("&amp;", "&").replace("&#38;", "&"))
                out.append(u.split("#")[0] if urlsplit(u).scheme in ("http", "https") and urlsplit(u).hostname else None)
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(raw, base)
