"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the values the
reference behaviour is defined by (tag and attribute allowlists, unsafe
tokens, colour names, hint words, scoring constants, fallback markup).
They are listed plainly, in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: markup allowlists and safety tokens
# ---------------------------------------------------------------------------
ALLOWED_TAGS = (
    "svg", "g", "path", "rect", "circle", "ellipse", "line", "polyline",
    "polygon", "defs", "use", "symbol", "clipPath", "mask",
    "linearGradient", "radialGradient", "stop", "text", "tspan",
    "title", "desc", "style", "pattern", "marker", "filter",
)

ALLOWED_ATTRS = (
    "xmlns", "width", "height", "viewBox", "x", "y", "x1", "y1", "x2", "y2",
    "cx", "cy", "r", "rx", "ry", "d", "points", "fill", "fill-rule",
    "fill-opacity", "stroke", "stroke-width", "stroke-opacity", "stroke-linecap",
    "stroke-linejoin", "stroke-miterlimit", "stroke-dasharray", "stroke-dashoffset",
    "opacity", "transform", "id", "class", "clip-path", "mask", "href",
    "xlink:href", "gradientUnits", "gradientTransform", "offset", "stop-color",
    "stop-opacity", "patternUnits", "patternTransform", "preserveAspectRatio",
    "font-size", "font-family", "font-weight", "text-anchor", "letter-spacing",
    "dominant-baseline", "filter", "marker-start", "marker-mid", "marker-end",
    "style", "version",
)

UNSAFE_TOKENS = (
    "javascript:", "vbscript:", "data:", "http://", "https://",
    "file:", "<script", "</script", "@import",
)

# attributes whose value must be a local "#id" / url(#id) reference
REFERENCE_ATTRS = (
    "href", "xlink:href", "clip-path", "mask", "filter",
    "marker-start", "marker-mid", "marker-end",
)
# attributes dropped when longer than LONG_NAME_LIMIT characters
NAME_ATTRS = ("id", "class", "font-family")
LONG_NAME_LIMIT = 120
TEXT_LIMIT = 2000

SVG_NAMESPACE = "http://www.w3.org/2000/svg"
CANVAS = 256
MAX_MARKUP_CHARS = 16000
MIN_MARKUP_CHARS = 50
MAX_PATHS = 256

DRAWABLE_TAGS = ("path", "rect", "circle", "ellipse", "line", "polygon", "polyline", "text", "use")
NON_PAINT_VALUES = ("none", "transparent", "inherit", "")
VISIBLE_CHANNEL_LIMIT = 245

# ---------------------------------------------------------------------------
# FIXED VALUES: named colours (r, g, b) in their natural order
# ---------------------------------------------------------------------------
COLOR_RGB = (
    ("black", (0, 0, 0)),
    ("white", (255, 255, 255)),
    ("red", (255, 0, 0)),
    ("green", (0, 128, 0)),
    ("blue", (0, 0, 255)),
    ("yellow", (255, 255, 0)),
    ("orange", (255, 165, 0)),
    ("purple", (128, 0, 128)),
    ("pink", (255, 192, 203)),
    ("gray", (128, 128, 128)),
    ("grey", (128, 128, 128)),
    ("brown", (165, 42, 42)),
    ("gold", (255, 215, 0)),
    ("silver", (192, 192, 192)),
)
COLOR_WORDS = tuple(name for name, _ in COLOR_RGB)

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt hints
# ---------------------------------------------------------------------------
COMPLEXITY_HINTS = (
    "illustration", "detailed", "complex", "many", "multiple", "pattern",
    "icon set", "logo", "scene", "stack", "five", "several",
)
COMPLEX_PROMPT_CHARS = 120

# shape word in the prompt -> marker expected in the markup
SHAPE_HINTS = (
    ("circle", "<circle"), ("ring", "<circle"), ("dot", "<circle"),
    ("rectangle", "<rect"), ("square", "<rect"), ("line", "<line"),
    ("stripe", "<rect"), ("triangle", "<polygon"), ("polygon", "<polygon"),
    ("text", "<text"), ("gradient", "gradient"), ("star", "<polygon"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: fallback markup
# ---------------------------------------------------------------------------
FALLBACK_COLORS = (
    ("red", "#e53935"), ("blue", "#1e88e5"), ("green", "#43a047"),
    ("yellow", "#fdd835"), ("orange", "#fb8c00"), ("purple", "#8e24aa"),
    ("pink", "#e91e63"), ("gray", "#757575"), ("grey", "#757575"),
    ("white", "#f5f5f5"), ("black", "#212121"), ("gold", "#ffc107"),
    ("brown", "#6d4c41"), ("teal", "#00897b"), ("cyan", "#00bcd4"),
)
FALLBACK_DEFAULT_FILL = "#212121"
FALLBACK_LIGHT_BG = "#f5f5f5"
FALLBACK_DARK_BG = "#212121"
FALLBACK_SHAPE_WORDS = (
    ("circle", ("circle", "round", "dot", "ring", "ball")),
    ("triangle", ("triangle",)),
    ("bars", ("line", "stripe", "bar", "menu", "list")),
    ("star", ("star",)),
)
STAR_POINTS = "128,40 150,100 214,100 162,138 182,200 128,160 74,200 94,138 42,100 106,100"

# canonical text of the safety-pass document: white canvas, black rounded square
SAFETY_MARKUP = (
    '<svg xmlns="http://www.w3.org/2000/svg" width="256" height="256" viewBox="0 0 256 256">'
    '<rect width="256" height="256" fill="white" />'
    '<rect x="40" y="40" width="176" height="176" rx="24" fill="black" /></svg>'
)

# ---------------------------------------------------------------------------
# FIXED VALUES: scoring and planning constants
# ---------------------------------------------------------------------------
SEED = 42
MAX_PROMPT_CHARS = 700
EASY_CANDIDATES = 4
COMPLEX_CANDIDATES = 12
WEAK_GREEDY_CANDIDATES = 16
WEAK_GREEDY_SCORE = 1035.0
WEAK_GREEDY_COVERAGE = 0.08
GREEDY_TOKENS = (1024, 2048)          # simple, complex
SAMPLE_TOKENS = (768, 1024)           # simple, complex
BASE_TEMPERATURE = 0.68
SAMPLING_BATCH = 4
RERANK_TOP_K = 3
RETRIEVAL_TOP_K = 4
EMBEDDING_WEIGHT = 12.0               # weight of the text-image similarity in the rerank
OVERSAMPLE_FACTOR = 0.30
BALANCE_POWER = 0.5
EVAL_FRACTION = 0.02
MIN_EVAL_ROWS = 128
MAX_EVAL_ROWS = 1000
LONG_CONTEXT_FRACTION = 0.30
LONG_CONTEXT_MIN_TRAIN = 4096
LONG_CONTEXT_MIN_EVAL = 128
LEADERBOARD_KEEP = 8
MISSING_MAE = 1e9
IGNORE_INDEX = -100

# FIXED VALUE: system message of every chat row
SYSTEM_PROMPT = (
    "You generate SVG images from text descriptions.\n\n"
    "Requirements:\n"
    "- Return only one complete SVG document: <svg>...</svg>\n"
    "- Output valid XML that renders without errors\n"
    "- Use a 256x256 canvas with width, height, and viewBox\n"
    "- Keep the drawing visible, centered, and large enough to read clearly\n"
    "- Match the prompt's subject, shape, and colors as closely as possible\n"
    "- Prefer simple structure, but include enough detail to avoid generic icons\n"
    "- No scripts, animation, or external references"
)
