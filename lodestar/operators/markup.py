"""Static rules over CSS and HTML text, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import css_px

#: Tags of reading text, and words in selectors of controls.
PROSE = ("p", "li", "blockquote", "dd", "article", "body", "html", "main")
CONTROLS = ("button", "input", "select", "textarea", "label", "nav", "badge", "tab", "chip", "tag", "btn", "menu", "caption")
#: Colours that are no accent.
PLAIN = ("transparent", "currentcolor", "inherit", "initial", "unset", "none", "black", "white", "gray", "grey", "silver", "gainsboro", "whitesmoke")
#: Least sizes of text, and of side borders (rounded, plain), in pixels.
TEXT_PX, CONTROL_PX, ROUNDED_PX, BORDER_PX = 12, 11, 2.0, 4.0
#: Properties that hold colours, and colours written out.
COLOURED = (
    "color", "background", "background-color", "background-image", "border", "border-color", "outline", "outline-color", "fill", "stroke",
    "box-shadow", "text-shadow", "caret-color", "accent-color",
)
COLOUR = r"(?i)(#[0-9a-f]{3,8}\b|\b(?:rgba?|hsla?|hwb|lab|lch|oklab|oklch)\([^)]*\))"
#: Copy that was never replaced.
COPY = {
    "lorem ipsum": r"(?i)\blorem ipsum\b|\bdolor sit amet\b",
    "TODO marker": r"\bTODO\b",
    "example.com": r"(?i)\bexample\.com\b",
    "placeholder name": r"(?i)\b(jane doe|john smith|john doe|example user)\b",
}
#: What the source of an image is until there is one.
NO_SOURCE = r"^(#|about:blank)?$|placeholder|placehold\.|path/to/|dummyimage"


def bare(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def css_rules(df: DataFrame, key: str, css: str) -> DataFrame:
    """key, rule (its number from 0), selector and declarations (property, value in order) of the innermost blocks of style sheets."""
    text = F.regexp_replace(F.coalesce(F.col(css), F.lit("")), r"(?s)/\*.*?\*/", " ")
    blocks = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"([^{};]*\{[^{}]*\})"))).alias("rule", "_b"))
    pieces = F.filter(F.split(F.regexp_extract("_b", r"(?s)\{(.*)\}", 1), ";"), lambda d: d.contains(":"))
    part = lambda d: F.struct(F.lower(bare(F.substring_index(d, ":", 1))).alias("property"), bare(F.regexp_replace(d, r"(?s)^[^:]*:", "")).alias("value"))
    return blocks.select(key, "rule", bare(F.regexp_replace("_b", r"(?s)\{.*", "")).alias("selector"), F.transform(pieces, part).alias("declarations"))


def _last(name: str) -> Column:
    """The value of the last declaration of a property, null without one."""
    return F.try_element_at(F.filter("declarations", lambda d: d["property"] == name), F.lit(-1))["value"]


def _any(test) -> Column:
    return F.exists("declarations", lambda d: test(d["property"], d["value"]))


def _accent(colour: Column) -> Column:
    low = F.lower(bare(colour))
    gray = low.rlike(r"^#([0-9a-f])\1\1[0-9a-f]?$|^#([0-9a-f]{2})\2\2([0-9a-f]{2})?$")
    return ~low.isin(*PLAIN) & ~gray


def css_findings(rules: DataFrame, key: str) -> DataFrame:
    """key, rule, selector and finding of css_rules: gradient_text, side_border (one for each side) and tiny_text."""
    clipped = (F.lower(_last("background-clip")) == "text") | (F.lower(_last("-webkit-background-clip")) == "text")
    gradient = clipped & _any(lambda p, v: p.isin("background", "background-image") & F.lower(v).contains("gradient("))
    rounded = _any(lambda p, v: p.endswith("radius") & F.exists(F.split(F.replace(v, F.lit("/"), F.lit(" ")), r"\s+"), lambda x: (F.coalesce(css_px(x), F.lit(0.0)) != 0) | (x.endswith("%") & (x != "0%"))))
    limit = F.when(rounded, ROUNDED_PX).otherwise(BORDER_PX)

    def side(name: str) -> Column:
        parts = F.regexp_extract_all(_last(name), F.lit(r"((?:[^\s(]|\([^)]*\))+)"))
        width = F.try_element_at(F.filter(F.transform(parts, css_px), lambda x: x.isNotNull()), F.lit(-1))
        colour = F.try_element_at(F.filter(parts, lambda x: css_px(x).isNull() & ~F.lower(x).isin("solid", "dashed", "dotted", "double", "none")), F.lit(-1))
        bare = F.exists(parts, lambda x: F.lower(x) == "none")
        return F.when(~bare & (width >= limit) & _accent(colour), "side_border")

    size, low = css_px(_last("font-size")), F.lower("selector")
    prose = F.exists(F.regexp_extract_all(low, F.lit(r"(?:^|[\s>+~,])([a-z][a-z0-9]*)(?![\w-])")), lambda tag: tag.isin(*PROSE))
    control = low.rlike("|".join(CONTROLS)) | ~prose
    tiny = (size > 0) & (size < F.when(control, CONTROL_PX).otherwise(TEXT_PX))
    found = F.array_compact(F.array(F.when(gradient, "gradient_text"), side("border-left"), side("border-right"), F.when(tiny, "tiny_text")))
    return rules.select(key, "rule", "selector", F.explode(found).alias("finding"))


def colour_name(text: Column) -> Column:
    """A colour in lower case without spaces, short hexadecimal ones written out."""
    low = F.regexp_replace(F.lower(text), r"\s", "")
    return F.when(low.rlike(r"^#[^ ]{3,4}$"), F.concat(F.lit("#"), F.regexp_replace(F.substring(low, 2, 8), "(.)", "$1$1"))).otherwise(low)


def colour_findings(rules: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """key, rule, property and colour of the colours that declarations write out and no token (value) has.

    Properties of one's own (--x) and fallbacks of var() aren't looked at; without any token of a colour there is no finding.
    """
    value = bare(F.col("value"))
    named = tokens.filter(F.regexp_replace(value, COLOUR, "") == "").filter(value != "").select(colour_name(value).alias("colour")).distinct()
    d = rules.select(key, "rule", F.explode("declarations").alias("d")).select(key, "rule", "d.*")
    border = F.col("property").rlike("^(border|outline)-") & ~F.col("property").rlike("(radius|width|style|offset)$")
    d = d.filter(~F.startswith("property", F.lit("--")) & (F.col("property").isin(*COLOURED) | border))
    # innermost calls first: a fallback may hold another call
    value = F.col("value")
    for _ in range(4):
        value = F.regexp_replace(value, r"\bvar\((?:[^()]|\((?:[^()])*\))*\)", " ")
    used = d.select(key, "rule", "property", F.explode(F.regexp_extract_all(value, F.lit(COLOUR))).alias("c")).select(key, "rule", "property", colour_name(F.col("c")).alias("colour"))
    return used.join(named, "colour", "left_anti").select(key, "rule", "property", "colour").filter(F.lit(bool(named.head(1))))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of a tag: null without it, empty without a value."""
    m = rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = F.concat(*(F.regexp_extract(tag, m, g) for g in (2, 3, 4)))
    return F.when(tag.rlike(m), value).when(tag.rlike(rf"(?is)\s{name}(?=[\s/>])"), "")


def _matching(pattern: str):
    return lambda x: x.rlike(pattern)


def html_findings(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, finding and number of the page rules: basics (lang, title, viewport: only with an <html>), images and placeholder copy."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<!--.*?-->", " ")
    page = df.select(key, text.alias("_t")).withColumn("_root", F.regexp_extract("_t", r"(?is)<html\b[^>]*>", 0))
    metas = F.regexp_extract_all("_t", F.lit(r"(?is)(<meta\b[^>]*>)"))
    images = F.regexp_extract_all("_t", F.lit(r"(?is)(<img\b[^>]*>)"))
    titles = F.regexp_extract_all("_t", F.lit(r"(?is)<title\b[^>]*>(.*?)</title"))
    has = F.col("_root") != ""
    one = lambda c: F.when(has & c, 1).otherwise(0)
    source = lambda i: F.lower(F.trim(F.coalesce(_attribute(i, "src"), F.lit(""))))
    unset = lambda i: source(i).rlike(NO_SOURCE) & ~((source(i) == "") & (F.trim(F.coalesce(_attribute(i, "srcset"), F.lit(""))) != ""))
    seen = F.regexp_replace(F.regexp_replace("_t", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"""(?is)<(?:[^<>"']|"[^"]*"|'[^']*')*>""", "\n")
    worded = F.regexp_extract_all("_t", F.lit(r"""(?is)\s(?:alt|title|placeholder|aria-label|href)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""))
    copy = F.concat(F.split(seen, "\n"), worded)
    counts = {
        "no_lang": one(F.trim(F.coalesce(_attribute(F.col("_root"), "lang"), F.lit(""))) == ""),
        "no_title": one(~F.exists(titles, lambda t: F.trim(t) != "")),
        "no_viewport": one(~F.exists(metas, lambda m: F.lower(F.coalesce(_attribute(m, "name"), F.lit(""))) == "viewport")),
        "image_without_alt": F.size(F.filter(images, lambda i: _attribute(i, "alt").isNull())),
        "image_without_source": F.size(F.filter(images, unset)),
        **{f"copy: {name}": F.size(F.filter(copy, _matching(pattern))) for name, pattern in COPY.items()},
    }
    pairs = F.array(*(F.struct(F.lit(name).alias("finding"), n.cast("long").alias("n")) for name, n in counts.items()))
    return page.select(key, F.explode(F.filter(pairs, lambda x: x["n"] > 0)).alias("f")).select(key, "f.*")


#: The elements that are labels for something else, what a label may not hold, and when short text reads as a kicker.
NOT_KICKERS = "a button label input select option li th td nav time code pre summary figcaption dt dd h1 h2 h3 h4 h5 h6".split()
KICKER_WORDS, KICKER_LENGTH, KICKER_EM, KICKER_PX, KICKER_CAPS = 7, 56, 0.04, 15.0, 0.6


def kicker_signals(text: Column, style: Column) -> Column:
    """How many of five signals a label's text and style (a map) give: capitals, tracking, small size, monospace, small capitals."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    caps = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) >= KICKER_CAPS * F.greatest(F.length(letters), F.lit(1))
    get = lambda k: F.lower(F.coalesce(F.try_element_at(style, F.lit(k)), F.lit("")))
    size, spacing = css_px(get("font-size")), get("letter-spacing")
    em = F.when(spacing.rlike(r"^\s*-?[0-9.]+em\s*$"), F.regexp_replace(spacing, r"\s|em", "").try_cast("double")).otherwise(css_px(spacing) / F.coalesce(size, F.lit(16.0)))
    signals = (get("text-transform").contains("uppercase") | caps, em >= KICKER_EM, size <= KICKER_PX, get("font-family").contains("mono"), get("font-variant-caps").contains("small-caps"))
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals[1:]), F.coalesce(signals[0], F.lit(False)).cast("int"))
