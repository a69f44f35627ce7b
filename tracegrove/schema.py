"""Fixed values of the data model."""

# Default weight of each edge type, where an edge has none.
EDGE_WEIGHTS = {"contains": 1.0, "imports": 0.5, "calls": 2.0, "inherits": 1.5, "references": 0.8, "reads": 1.2, "writes": 1.6, "documents": 1.0, "documented_by": 1.0}
NODE_TYPES = ("file", "class", "function", "method", "variable", "table", "column", "query", "doc_section")
CALLABLE = ("function", "method")

# Request bounds: depth, nodes, hops, limits.
BOUNDS = {
    "subgraph_depth": (0, 50), "subgraph_nodes": (10, 5000), "tree_depth": (0, 50), "max_hops": (1, 200), "entrypoint_limit": (1, 500), "reach_depth": (0, 200), "reach_nodes": (10, 20000),
    "search_limit": (1, 500), "semantic_limit": (1, 200), "repo_map_budget": (200, 10000), "top_n": (1, 200), "resolve_limit": (1, 50), "tune_rate": (0.01, 0.5), "tune_percentile": (50, 99), "tune_files": (10, 5000),
}

# Hotspot weights.
WEIGHTS = {"error": 5.0, "warning": 1.0, "todo": 3.0, "fixme": 4.0, "hack": 2.0, "churn": 0.5, "in": 0.3, "out": 0.2, "centrality": 0.2, "logic": 1.0, "concurrency": 2.0, "risk": 1.5, "high": 5.0, "churn_threshold": 5}

# Fixed values, entrypoints: scores of file names, of function names, and of decorator texts.
ENTRY_FILES = {
    "main.py": 0.95, "app.py": 0.9, "cli.py": 0.9, "manage.py": 0.9, "server.py": 0.9, "index.js": 0.9, "server.js": 0.9, "app.ts": 0.9, "main.go": 0.95, "main.rs": 0.95,
}
ENTRY_NAMES = {"main": 0.9, "run": 0.6, "start": 0.6, "cli": 0.8, "execute": 0.5, "serve": 0.6}
ENTRY_DECORATORS = {
    "app.command": 0.95, "click.command": 0.95, "click.group": 0.9, "app.get": 0.9, "app.post": 0.9, "app.put": 0.9, "app.delete": 0.9, "app.route": 0.9, "router.get": 0.85, "router.post": 0.85, "router.route": 0.85,
    "restcontroller": 0.9, "getmapping": 0.9, "postmapping": 0.9, "task": 0.7, "celery.task": 0.8, "cron": 0.8, "scheduler": 0.8, "on_message": 0.8,
}
ENTRY_META = {"is_main_guard": 0.98, "is_entrypoint": 0.98}

# Fixed values, complexity: words whose occurrence in a line counts, per language.
LOGIC_WORDS = {
    "python": ["if ", "elif ", "else:", "for ", "while ", "try:", "except ", "with ", "def ", "class "],
    "javascript": ["if", "else", "for", "while", "try", "catch", "switch", "case", "function", "class"],
    "go": ["if", "else", "for", "switch", "select", "func", "go "],
    "rust": ["if", "else", "match", "loop", "while", "for", "fn ", "impl "],
    "java": ["if", "else", "for", "while", "switch", "try", "catch", "class ", "interface "],
    "cpp": ["if", "else", "for", "while", "switch", "try", "catch", "class ", "struct ", "template"],
    "csharp": ["if", "else", "for", "foreach", "while", "switch", "try", "catch", "class ", "struct "],
    "ruby": ["if ", "else", "elsif", "unless", "while", "until", "case", "def ", "class ", "module "],
    "php": ["if", "else", "elseif", "foreach", "while", "switch", "try", "catch", "function ", "class "],
    "swift": ["if ", "else", "switch", "for ", "while ", "guard ", "func ", "class ", "struct "],
}
LOGIC_LANGUAGE = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "cpp", "h": "cpp", "cs": "csharp", "rb": "ruby"}

# Markers of concurrency. Repeated ones count as often as they stand here.
CONCURRENCY = [
    r"async\s+def\s+", r"\s+await\s+", r"asyncio\.", r"threading\.", r"multiprocessing\.", r"concurrent\.futures", r"Lock\(", r"Semaphore\(", r"Queue\(",
    r"async\s+function", r"\s+await\s+", r"Promise", r"setTimeout",
    r"go\s+\w+", r"chan\s+", r"select\s+\{", r"sync\.Mutex", r"sync\.WaitGroup",
    r"Thread", r"Runnable", r"CompletableFuture", r"synchronized", r"ExecutorService",
    r"std::thread", r"std::async", r"std::mutex", r"std::future",
    r"Task\.Run", r"Task<", r"await\s+", r"Thread\.", r"lock\s*\(",
    r"Task\s*\{", r"await\s+", r"actor\s+", r"DispatchQueue",
    r"Thread\.new", r"Mutex\.new", r"pthreads", r"Worker",
]

# Markers of risk (environment, network, processes, evaluation).
RISK = [
    r"os\.environ", r"os\.getenv", r"process\.env", r"std::env", r"System\.getenv", r"Environment\.GetEnvironmentVariable", r"ENV\[", r"\$_ENV",
    r"requests\.", r"httpx\.", r"boto3\.", r"sqlalchemy\.", r"psycopg2", r"redis\.", r"pymongo", r"fetch\(", r"axios\.", r"http\.Get", r"http\.Post", r"database/sql",
    r"java\.net", r"HttpClient", r"ProcessBuilder", r"Process\.Start", r"Runtime\.exec", r"system\(", r"popen\(", r"Net::HTTP", r"curl_", r"shell_exec", r"\$_GET", r"\$_POST", r"URLSession",
    r"eval\(", r"exec\(", r"subprocess\.", r"os\.system",
]


def bounded(name: str, value):
    """``value`` if it lies within the bounds of ``name``."""
    low, high = BOUNDS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value
