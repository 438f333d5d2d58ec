"""Fixed values of the HTML standard that the parser, serializers and selectors use."""

from __future__ import annotations

import html.entities

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details
    dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
    iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext
    pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul
    wbr xmp""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet caption html table td th marquee object template mi mo mn ms mtext annotation-xml foreignObject desc title".split())
LIST_SCOPE = SCOPE | {"ol", "ul"}
BUTTON_SCOPE = SCOPE | {"button"}
TABLE_SCOPE = frozenset("html table template".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IMPLIED_END_ALL = IMPLIED_END | frozenset("caption colgroup tbody td tfoot th thead tr".split())
#: Start tags in a body that close an open p, and end tags that need their element in scope.
BLOCK_START = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
BLOCK_END = (BLOCK_START - {"p"}) | {"button", "listing", "pre"}
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes script style template title".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
#: Tags that end foreign content.
BREAKOUT = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre
    ruby s small span strong strike sub sup table tt u ul var""".split()
)
MATHML_TEXT = frozenset("mi mo mn ms mtext".split())
SVG_HTML = frozenset("foreignObject desc title".split())

#: Fixed spellings of SVG element names.
SVG_NAMES = {
    n.lower(): n
    for n in """altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix
    feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood
    feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight
    feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath""".split()
}
#: Fixed spellings of SVG attribute names.
SVG_ATTRIBUTES = {
    n.lower(): n
    for n in """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits
    glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust
    limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength
    patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio
    primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent
    spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength
    viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan""".split()
}
#: Fixed names of attributes with a prefix in foreign content; the prefix is set off by a space.
FOREIGN_ATTRIBUTES = {n: n.replace(":", " ") for n in "xlink:actuate xlink:arcrole xlink:href xlink:role xlink:show xlink:title xlink:type xml:lang xml:space xmlns xmlns:xlink".split()}

#: Character references, from the standard library: all names without their semicolon, and those that are valid without one.
NAMED = {name[:-1]: value for name, value in html.entities.html5.items() if name.endswith(";")}
LEGACY = frozenset(name for name in html.entities.html5 if not name.endswith(";"))
LONGEST_LEGACY = max(map(len, LEGACY))
#: Fixed code points that numeric references in the C1 range stand for: those of windows-1252.
C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def numeric_reference(code: int) -> str:
    """The text of a numeric character reference."""
    if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "\ufffd"
    return C1.get(code) or chr(code)
