"""Text of pages, sentences and names, as native columns.

White space is that of ECMAScript (``\\s`` there holds more than in Java), word
edges are ASCII, and case folds by Unicode, as the rules of section reading ask.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Stands for the < of an opening without a close; no character of a text.
UNCLOSED = "\uffff"
MIN_READABLE, MIN_SHELL, MAX_BODY = 200, 40, 5 * 1024 * 1024
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
VERSION = [rf"(?iu){_B}(version|versi[oó]n|v){SPACE}?[0-9]+\.[0-9]+(\.[0-9]+)?{_E}", rf"(?iu){_B}(last updated|updated on|last modified|[uú]ltima actualizaci[oó]n|actualizado el){_E}", r"(?i)<time\b[^<>]*datetime="]
MCP = rf"(?iu){_B}model context protocol{_E}|{_B}mcp server{_E}|{_B}servidor mcp{_E}|{_B}mcp{SPACE}+(endpoint|integration|integraci[oó]n){_E}"
RESTRICTION = (
    r"(?iu)^(do not|don(?:'|’|&rsquo;|&#8217;|&#39;)?t|never|avoid|no (uses?|utilices|utilizar|usar|combines?|mezcles?|pongas?|agregues?)|nunca|evit(a|á|ar)|no se debe)"
    rf"{SPACE}+[^\s].{{2,180}}$"
)
TYPE_WORDS = "^(string|number|boolean|null|undefined|object|any|node|function|reactnode|element)$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), "^ | $", "")


def _open(tags: str) -> str:
    return rf"<(?:{tags})(?=[\s/>])"


def closed(html: Column, *tags: str) -> Column:
    """html, where openings of tags that no close follows have UNCLOSED for their ``<``.

    A pattern that looks for a close from every opening takes quadratic time on pages of unclosed tags. The close that
    an opening needs comes after its own ``>``, so the last opening that has one is before the last ``>`` before the last close:
    what comes later is marked, and from every other opening the pattern succeeds. Each step is linear."""

    def one(tag: str) -> Callable[[Column], Column]:
        def mark(h: Column) -> Column:
            upto = F.regexp_extract(h, rf"(?is)^(.*>)[^>]*</{tag}\s*+>", 1)
            rest = lambda a: F.regexp_replace(F.substr(h, F.length(a) + 1), rf"(?i)<(?={tag}[\s/>])", UNCLOSED)
            return F.when(h.rlike("(?i)" + _open(tag)), once(upto, lambda a: F.concat(a, rest(a)))).otherwise(h)

        return mark

    out = html
    for tag in tags:
        out = once(out, one(tag))
    return out


def _again(text: Column) -> Column:
    return F.replace(text, F.lit(UNCLOSED), F.lit("<"))


def without_block(html: Column, *tags: str) -> Column:
    """Blocks of tags, from an opening to its first close, replaced by a space; of blocks that overlap, the one that opens first."""
    pattern = rf"(?is)<({'|'.join(tags)})(?=[\s/>])[^>]*>.*?</\1\s*>"
    return _again(F.regexp_replace(closed(html, *tags), pattern, " "))


def strip_tags(html: Column) -> Column:
    s = without_block(without_block(F.coalesce(html, F.lit("")), "script"), "style")
    # After the last > nothing is a tag; a pattern would look for one from every <.
    upto = lambda h: F.regexp_extract(h, "(?s)^.*>", 0)
    plain = once(s, lambda h: once(upto(h), lambda a: F.concat(F.regexp_replace(a, "<[^>]+>", " "), F.substr(h, F.length(a) + 1))))
    return collapse(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")))


def body_of(html: Column) -> Column:
    def inner(h: Column) -> Column:
        return F.when(h.rlike("(?i)" + _open("body")), F.regexp_extract(h, r"(?is)<body(?=[\s/>])[^>]*>(.*?)</body\s*>", 1)).otherwise(h)

    return _again(once(closed(html, "body"), inner))


def visible_text(html: Column) -> Column:
    """Text of the body outside menus and templates. Nav-like blocks go from the one that opens first."""
    return strip_tags(without_block(body_of(F.coalesce(html, F.lit(""))), "head", "nav", "header", "footer", "noscript", "template"))


def visible_text_length(html: Column) -> Column:
    return F.length(visible_text(html))


def blocks(html: Column, *tags: str) -> Column:
    """Inner HTML of the blocks of some tags."""
    pattern = rf"(?is)<({'|'.join(tags)})(?=[\s/>])[^>]*>(.*?)</\1\s*>"
    return F.transform(F.regexp_extract_all(closed(F.coalesce(html, F.lit("")), *tags), F.lit(pattern), F.lit(2)), _again)


def headings(html: Column) -> Column:
    return F.filter(F.transform(blocks(html, "h1", "h2", "h3"), strip_tags), lambda t: t != "")


def code_blocks(html: Column) -> Column:
    return F.transform(blocks(html, "pre"), strip_tags)


def first_paragraph(html: Column) -> Column:
    """The first paragraph after the first h1-h3, or the first of all; null if it has no text."""
    rest = _again(F.regexp_replace(closed(html, "h1", "h2", "h3"), r"(?is)^.*?<(h[1-3])(?=[\s/>])[^>]*>.*?</\1\s*>", ""))
    text = strip_tags(_again(F.regexp_extract(closed(rest, "p"), r"(?is)<p(?=[\s/>])[^>]*>(.*?)</p\s*>", 1)))
    return once(text, lambda t: F.when(t != "", t))


def links(html: Column) -> Column:
    """href values in order, quotes off; fragments of the same page and empty ones left out."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^<>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", ""))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def version_signal(text: Column) -> Column:
    return text.rlike(VERSION[0]) | text.rlike(VERSION[1]) | text.rlike(VERSION[2])


def mcp_signal(text: Column) -> Column:
    return text.rlike(MCP)


def is_shell(content_type: Column, body: Column) -> Column:
    html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))
    b = F.coalesce(body, F.lit(""))
    asks = b.rlike(r"(?iu)(requires|enable|activ[ae]r?|habilit[ae]r?|necesit\w+)\s[^<>]{0,60}javascript")
    return html & ((b == "") | asks | (visible_text_length(b) < MIN_SHELL))


def needs_browser(content_type: Column, body: Column) -> Column:
    html = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))
    return html & (is_shell(content_type, body) | (visible_text_length(body) < MIN_READABLE))


def sentences(text: Column) -> Column:
    """Sentences of a text, without the marks and space at their ends."""
    parts = F.split(text, rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "[.!?]+$", ""), f"^{SPACE}+|{SPACE}+$", "")), lambda s: s != "")


def restrictions(text: Column) -> Column:
    return F.array_distinct(F.filter(sentences(text), lambda s: s.rlike(RESTRICTION)))


def normalize_empty(value: Column) -> Column:
    s = F.regexp_replace(F.coalesce(value, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when((s != "") & ~s.rlike("(?i)^(-|—|–|n/a|none|undefined)$"), s)


def allowed_values(kind: Column) -> Column:
    """Two or more quoted literals, else two or more alternatives that aren't type names."""
    quoted = F.regexp_extract_all(kind, F.lit("[\"'`]([^\"'`]{1,40})[\"'`]"), F.lit(1))
    parts = F.filter(F.transform(F.split(kind, r"\|"), lambda s: F.trim(s)), lambda s: s.rlike("^[A-Za-z0-9_-]{1,30}$") & ~F.lower(s).rlike(TYPE_WORDS))
    none = F.array().cast("array<string>")
    return (
        F.when(kind.isNull(), none)
        .when(F.size(quoted) >= 2, F.array_distinct(quoted))
        .when(F.contains(kind, F.lit("|")) & (F.size(parts) >= 2), F.array_distinct(parts))
        .otherwise(none)
    )


def is_token_name(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    shape = n.rlike(r"^(\$|--|@)[A-Za-z][A-Za-z0-9_-]*([.-][A-Za-z0-9_-]+)*$") | n.rlike(r"^[A-Za-z][A-Za-z0-9_-]*([.-][A-Za-z0-9_-]+)+$") | n.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$")
    return (F.length(n) >= 2) & (F.length(n) <= 80) & shape


def guess_type(name: Column) -> Column:
    low = F.lower(name)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return (
        F.when(has("color"), "color").when(has("space", "spacing", "size"), "spacing").when(has("font", "type"), "typography")
        .when(has("radius"), "radius").when(has("shadow"), "shadow").otherwise("other")
    )


def token_category(value: Column, name: Column) -> Column:
    """An alias value or a path of more than two parts makes a token semantic."""
    alias = F.coalesce(value, F.lit("")).rlike(r"^(\$|--|\{|var\()")
    return F.when(alias | (F.size(F.split(name, r"\.")) > 2), "semantic")


def live_demos(html: Column) -> Column:
    return F.regexp_count(
        F.coalesce(html, F.lit("")),
        F.lit(
            r"""(?i)<iframe\b[^<>]*\bsrc\s*=\s*["'][^"']*(storybook|iframe\.html|codesandbox|stackblitz|codepen|playground|sandbox|demo)[^"']*["']"""
            r"""|<a\b[^<>]*\bhref\s*=\s*["'][^"']*(codesandbox\.io|stackblitz\.com|codepen\.io)[^"']*["']|\b(data-)?(playground|live-?demo|live-?code|sandpack)\b"""
        ),
    )


def component_name(title: Column, identity: Column) -> Column:
    """The shortest prefix of the title's words that folds to the identity; else the whole title."""

    def fold(x: Column) -> Column:
        plain = F.translate(F.lower(x), "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy")
        return F.regexp_replace(plain, "[^a-z0-9]", "")

    t = collapse(F.coalesce(title, F.lit("")))
    words = F.split(t, " ")
    lengths = F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: fold(F.array_join(F.slice(words, F.lit(1), k), " ")) == fold(F.coalesce(identity, F.lit(""))))
    found = F.array_join(F.slice(words, F.lit(1), F.try_element_at(lengths, F.lit(1))), " ")
    return F.when(t != "", F.when((fold(F.coalesce(identity, F.lit(""))) != "") & (F.size(lengths) > 0), found).otherwise(t))
