"""Words, names, patterns and numbers that must equal those of the semantics being reproduced.

They are stated plainly and in their natural order. Patterns that begin a line are tried at its first visible character.
"""

from __future__ import annotations

STOPWORDS = (
    "the", "and", "for", "with", "from", "into", "that", "this", "when", "what",
    "where", "which", "how", "does", "dont", "doesnt", "handle", "nicely", "issue",
    "expected", "actual", "behavior", "possible", "file", "hints", "before", "after",
    "function", "method", "class", "module", "call", "calls", "using", "used",
)

CODE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "c", "cc", "cpp", "cxx", "h", "hpp")

IGNORED_FOLDERS = (
    ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".venv", "venv", "env", "node_modules", "dist", "build",
    "coverage", ".next", ".turbo",
)
IGNORED_FOLDER_PREFIX = ".cache"

LANGUAGES = {
    "py": "python",
    "ts": "typescript",
    "tsx": "tsx",
    "js": "javascript",
    "jsx": "jsx",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "c": "c",
}

INTENTS = {
    "historical_decisions": (
        r"(?i)(?:decided|decision|chose|chosen|agreed|concluded)",
        r"(?i)(?:what did|why did|how did).*(?:decide|choose|pick|conclude)",
        r"(?i)(?:outcome|result|resolution)",
    ),
    "open_items": (
        r"(?i)(?:pending|todo|still need|remaining|left to|not yet|unfinished)",
        r"(?i)(?:open loop|follow.?up|blocker|waiting for)",
        r"(?i)(?:what's left|what remains|outstanding)",
    ),
    "reusable_skills": (
        r"(?i)(?:how to|how do|steps? to|procedure|process|method)",
        r"(?i)(?:best practice|pattern|approach|workflow)",
        r"(?i)(?:guide|tutorial|instructions?)",
    ),
    "entity_relations": (
        r"(?i)(?:who is|who are|what is|relationship between)",
        r"(?i)(?:works? at|belongs? to|connected to|related to)",
        r"(?i)(?:team|group|department|org)",
    ),
}
DEFAULT_INTENT = "background_supplement"

QUERY_TYPES = {
    "MEMORY": r"(?i)偏好|背景|身份|记忆|回顾|profile|preference|background|remember",
    "SKILL": r"(?i)怎么做|步骤|命令|流程|how\s*to|workflow|procedure|instruction|tutorial",
    "RESOURCE": r"(?i)文档|资料|规范|链接|document|spec|reference|link|paper|article",
}
DEFAULT_QUERY_TYPE = "MEMORY"

QUERY_NOISE = (
    r"(?s)```.*?```",
    r"Sender\s*\(untrusted metadata\)\s*:\s*",
    r"\[[\w\s:\-]+UTC\]\s*",
)

# Begin a line.
ERROR_LINE = (
    r"(?i)\b(ERROR|SEVERE)\b",
    r"(?i)\bFAIL(ED|URE)?\b",
    r"Traceback\s*\(most recent call last\)",
    r'File\s+".*",\s+line\s+\d+',
    r"(?i)\bException\b",
    r"(?i)\bFailed to\b",
    r"(?i)\berrno\s*[=:]\s*\d+",
)

# Begin a line.
WARNING_LINE = (
    r"(?i)\bWARN(ING)?\b",
    r"(?i)\bDeprecat(ed|ion)\b",
    r"(?i)\bCaution\b",
    r"(?i)\bUnsupported\b",
)

# Begin a line.
CRITICAL_LINE = (
    r"(def|class|async def)\s+\w+",
    r"(import|from)\s+",
    r"(?i)\b(ERROR|SEVERE|Exception|Failed)\b",
    r"(?i)\b(return|raise|yield)\b",
    r"#.*",
    r"\b(if|else|elif|for|while|try|except|finally)\s*[:(]",
)

# Anywhere in a line.
ERROR_ANYWHERE = (
    r"(?i)error[:\s]",
    r"(?i)exception[:\s]",
    r"(?i)failed[:\s]",
    r"(?i)(?:^|\s)\[failure\]",
    r"(?i)^failure_count\s*=\s*[1-9]",
    r"Traceback \(most recent call last\)",
    r"(?i)panic[:\s]",
)

# Contained in a line in lower case.
WARNING_WORDS = ("warning", "warn:")

CONTENT_PATTERNS = {
    "ERROR": (
        r"(?i)\b(ERROR|SEVERE|FATAL|Exception|Failed)",
        r"Traceback\s*\(most recent call last\)",
        r'(?m)^\s*File\s+".*",\s+line\s+\d+',
        r"(?i)\bFailed to\b",
    ),
    "CODE": (
        r"(?m)^\s*(def|class|async\s+def|import|from|const|let|var|function)\s+",
        r"(?m)^\s*(if|else|elif|for|while|try|except|catch|switch)\s*[({]?",
        r"(?m)^\s*#.*",
        r'\{[\s\n]*"[^"]+":',
    ),
    "LOG": (
        r"(?m)^(?:\s*\d+\s+)?\d{4}-\d{2}-\d{2}[\sT]",
        r"(?m)^\[\s*(DEBUG|INFO|WARN|ERROR|FATAL)",
        r"(?im)^\[(summary|trace|failure|debug|info|warn|error|fatal)\]",
        r"(?m)^(failure_count|function_count|expected_source)=",
        r"(?i)\b(log|print|echo|printf|console\.log)\s*\(",
        r"(?m)^\s*at\s+[\w.$]+\([^)]*\)\s*$",
    ),
    "MEMORY": (
        r"(?im)^(Context|Memory|Archive|Overview|Abstract):",
        r"(?m)^\s*-\s+[\w\s]+:",
        r"(?m)^\s*##\s+\w+",
    ),
}
LOG_PREFIX = (
    r"(?m)^\s*(?:\d+\s+)?(?:"
    r"\d{4}-\d{2}-\d{2}[\sT].*\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b"
    r"|\[(?:summary|trace|failure|debug|info|warn|warning|error|fatal)\]"
    r")"
)

# The first name of a group stands for all of it.
SYNONYMS = (
    ("beverage", "coffee", "tea", "drink"),
    ("commute", "transport", "transportation", "travel_to_work"),
    ("note_taking", "notes", "note_tool"),
    ("coding_style", "code_style", "programming_style", "coding_preference"),
    ("music", "music_taste", "music_preference"),
    ("food", "food_preference", "diet", "eating"),
    ("exercise", "workout", "fitness", "gym"),
    ("reading", "books", "reading_preference"),
    ("sleep", "sleep_habit", "sleep_schedule"),
    ("weather", "weather_preference"),
    ("pets", "pet", "animals"),
)

# Field: weight, length normalisation.
BM25_FIELDS = {"symbol": (4.5, 0.05), "signature": (2.6, 0.20), "path": (1.2, 0.20), "body": (0.45, 0.65)}

# Kind of a symbol: words of a query that ask for it.
KIND_WORDS = {
    "function": ("function", "def", "fn", "method"),
    "async_function": ("async", "function", "def", "method"),
    "type": ("class", "type", "struct", "interface", "enum"),
    "code": ("code", "snippet"),
}

# Route of a code search: its weight in the fusion.
ROUTE_WEIGHTS = {"embedding": 0.33, "bm25": 0.17, "ctags": 0.17, "graph": 0.33}

# Tier of the token budget, in order of claim: least tokens, most tokens, keeps its least share first, takes what is left.
BUDGET_TIERS = {
    "identity": (500, 5_000, True, False),
    "session_state": (1_000, 10_000, True, False),
    "archive": (500, 40_000, False, False),
    "working_set": (0, 20_000, False, True),
}

# Kind of a command's output: words of its first ten lines, in lower case; the first kind with one of its words wins.
OUTPUT_WORDS = {
    "test": ("passed", "failed", "error", "test", "ok", "failures"),
    "build": ("compiling", "building", "cargo", "cmake", "make", "error:", "warning"),
    "log": ("debug", "info", "warn", "error", "trace", "[0m", "http://"),
}

INSTALL_DROP = (
    r"^Requirement already satisfied:",
    r"^Collecting ",
    r"^\s*Downloading ",
    r"^\s*Using cached ",
    r"^\s*Preparing metadata",
    r"^\s*Building wheel",
    r"^\s*Created wheel",
    r"^\s*Stored in directory",
    r"^\s*\|.*\|.*kB",
)
INSTALL_KEEP = (
    r"^Successfully installed",
    r"^Successfully uninstalled",
    r"^ERROR",
    r"^WARNING",
    r"^\s*ERROR",
    r"package needs to be reinstalled",
    r"Could not find",
)
ACCESS_DROP = (
    r"^\d+\.\d+\.\d+\.\d+ - - \[",
    r'"(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ',
    r"^[A-Z][a-z]+ HTTP/\d",
)
ACCESS_KEEP = (
    r"Traceback \(most recent call last\)",
    r"Exception",
    r"\b5\d\d\b",
    r"ERROR",
)

# Intent of a prompt: patterns that show it.
PROMPT_INTENTS = {
    "error": (r"(?i)\berror\b", r"(?i)\bfailed\b", r"(?i)\bcrash\b", r"(?i)\bbug\b", r"(?i)\bexception\b", r"(?i)\btraceback\b", r"(?i)\bpanicked?\b"),
    "implementation": (r"(?i)\bimplement\b", r"(?i)\badd\b", r"(?i)\bcreate\b", r"(?i)\bwrite\b", r"(?i)\bbuild\b", r"(?i)\bdevelop\b"),
    "refactoring": (r"(?i)\brefactor\b", r"(?i)\brestructure\b", r"(?i)\bimprove\b", r"(?i)\boptimize\b", r"(?i)\brewrite\b"),
    "research": (r"(?i)\bfind\b", r"(?i)\bsearch\b", r"(?i)\binvestigate\b", r"(?i)\blook\s+for\b", r"(?i)\bcheck\b", r"(?i)\banalyze\b", r"(?i)\bexplore\b"),
    "documentation": (r"(?i)\bdocument\b", r"(?i)\bexplain\b", r"(?i)\bdescribe\b", r"(?i)\bcomment\b", r"(?i)\bdocstring\b"),
    "question": (
        r"(?i)\bhow\s+do\s+I\b", r"(?i)\bhow\s+can\s+I\b", r"(?i)\bwhat\s+is\b", r"(?i)\bwhy\s+does\b",
        r"(?i)\bcan\s+you\b", r"(?i)\bhelp\s+me\b", r"(?i)\btell\s+me\b", r"(?i)\bwhat\s+if\b",
    ),
    "code-review": (r"(?i)\breview\b", r"(?i)\baudit\b", r"(?i)\bassess\b", r"(?i)\bevalua"),
    "debugging": (r"(?i)\bdebug\b", r"(?i)\bfix\b", r"(?i)\bpatch\b", r"(?i)\brepair\b", r"(?i)\bsolve\b"),
    "testing": (r"(?i)\btest\b", r"(?i)\bspec\b", r"(?i)\bverify\b", r"(?i)\bpytest\b", r"(?i)\bunittest\b"),
    "configuration": (r"(?i)\bconfig(ure|uration)?\b", r"(?i)\bsetup\b", r"(?i)\binstall\b", r"(?i)\bdeploy\b", r"(?i)\benv(ironment)?\b"),
    "git": (r"(?i)\bcommit\b", r"(?i)\bbranch\b", r"(?i)\bmerge\b", r"(?i)\brebase\b", r"(?i)\bstash\b", r"(?i)\bgit\b"),
    "shell": (r"(?i)\bshell\b", r"(?i)\bcommand\s+line\b", r"(?i)\bbash\b", r"(?i)\bscript\b", r"(?i)\bcli\b"),
}
DEFAULT_PROMPT_INTENT = "general"
PROMPT_TOPIC = (
    (r"(?i)\b(analyze|build|create|fix|implement|add|update|modify)\s+(the\s+)?(\w+)", 3),
    (r"(?i)\b(working\s+on|project|file|module|function|class|api)\s+(\w+)", 2),
)

REASONING = (
    r"(?im)^Let me think|First,? I|In summary,? |Therefore,? |The answer is",
    r"(?m)^Step \d+[\.:]\s",
    r"(?m)^\d+\.\s+[A-Z]",
    r"(?m)^\-\s+[A-Z][a-z]",
)
COMMON_ABBREVIATIONS = ("I", "A", "API", "URL", "ID", "LLM")
