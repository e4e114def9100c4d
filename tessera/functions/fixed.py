"""Word lists, tables and patterns that results depend on."""

# Stop words of chunk keywords.
CHUNK_STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "def", "end", "return", "function"
)

# Stop words of scored keywords.
SCORED_STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "def", "end", "return", "function",
    "const", "let", "var", "this", "that", "with", "from", "import", "export", "class", "if", "else", "then", "do", "while",
)

# Stop words of identifier keywords.
IDENTIFIER_STOP_WORDS = (
    "function", "class", "const", "let", "var", "if", "else", "elsif", "for", "while", "do", "switch", "case", "break", "continue", "return",
    "try", "catch", "finally", "throw", "new", "this", "def", "end", "module", "require", "include", "extend", "and", "or", "not", "the",
    "is", "are", "was", "were", "be",
)

# Query synonyms.
SYNONYMS = {
    "validation": ("validate", "validator", "check", "verify", "verification"),
    "validate": ("validation", "validator", "check", "verify"),
    "check": ("validate", "validation", "verify", "test"),
    "base": ("parent", "superclass", "abstract", "foundation"),
    "parent": ("base", "superclass", "ancestor"),
    "child": ("subclass", "derived", "descendant"),
    "create": ("add", "insert", "new", "build", "make"),
    "update": ("modify", "change", "edit", "set"),
    "delete": ("remove", "destroy", "drop"),
    "get": ("fetch", "retrieve", "find", "query"),
    "service": ("handler", "manager", "processor", "worker"),
    "controller": ("handler", "router", "endpoint"),
    "model": ("entity", "record", "data", "schema"),
    "helper": ("util", "utility", "tool"),
    "auth": ("authentication", "authorize", "login", "signin"),
    "authentication": ("auth", "login", "credential"),
    "permission": ("authorization", "access", "privilege"),
    "test": ("spec", "check", "verify", "validate"),
    "mock": ("stub", "fake", "dummy", "test"),
}

# Abbreviations of queries, in the order of their rewriting.
ABBREVIATIONS = (
    ("auth", "authentication"), ("config", "configuration"), ("params?", "parameters"), ("args?", "arguments"), ("req", "request"),
    ("res", "response"), ("doc", "document"), ("db", "database"), ("api", "interface"),
)

# Languages of file extensions.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rb": "ruby", ".py": "python", ".go": "go",
    ".java": "java"
}

# Price of a million tokens, dimensions and token limits of embedding models.
PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.1}
DIMENSIONS = {
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "nomic-embed-text": 768,
    "nomic-embed-large": 1024, "mxbai-embed-large": 1024, "all-minilm": 384
}
TOKEN_LIMITS = {
    "text-embedding-3-small": 8191, "text-embedding-3-large": 8191, "text-embedding-ada-002": 8191, "nomic-embed-text": 8192,
    "nomic-embed-large": 8192, "mxbai-embed-large": 512, "all-minilm": 512
}

# Coefficients of the estimate of an indexing run.
CHUNKS_PER_FILE = {"typescript": 6.0, "javascript": 6.0, "ruby": 3.5, "python": 4.5}
OTHER_CHUNKS_PER_FILE = 4.0
LOCAL_RATE = 28.0
RATES_BY_CONCURRENCY = ((5, 85.0), (4, 70.0), (3, 50.0))
SLOWEST_RATE = 35.0
FILES_PARSED_A_SECOND = 700.0
FIXED_SECONDS = 10.0
TOKENS_PER_CHUNK = 175

# Character classes. White space is ECMAScript's; words and their bounds are ASCII.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
PUNCTUATION = r"[.,;:!?(){}\[\]<>]"
OPERATORS = r"[=+\-*/%&|^~<>]"
CODE_SYNTAX = r"[{}()\[\];,.<>]"
QUERY_OPERATORS = r"[=+\-*/%&|^~]"
