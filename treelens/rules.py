"""Rule sets, as plain values and as small tables that can be joined and replaced.

Every operator takes a ``Rules``; the defaults are fixed values that results
depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Names, extensions and labels, in the order in which they are documented.
SCAN_IGNORE_DIRS = (".git", ".github", ".idea", ".vscode", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", ".next", ".pytest_cache", ".mypy_cache")
SCAN_IGNORE_FILES = (".DS_Store", "Thumbs.db", ".env", ".env.local", ".env.production", ".env.development", ".gitignore", ".coverage")
SUPPORTED_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".json", ".yaml", ".yml", ".toml", ".xml", ".html", ".css", ".scss", ".md", ".txt")
EXTENSION_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".cpp": "C++", ".c": "C",
    ".cs": "C#", ".go": "Go", ".rs": "Rust", ".php": "PHP", ".rb": "Ruby", ".swift": "Swift", ".kt": "Kotlin", ".json": "JSON", ".yaml": "YAML",
    ".yml": "YAML", ".xml": "XML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".md": "Markdown", ".txt": "Text",
}
ROOT_IGNORE_DIRS = (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", "target", "coverage", ".idea", ".vscode", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache")
COMMON_SOURCE_NAMES = ("src", "app", "backend", "frontend", "server", "client", "core", "engine", "api", "pkg", "lib", "libs")
PROJECT_FILES = ("requirements.txt", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "composer.json", "CMakeLists.txt", "Makefile")
ROOT_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".kt": "Kotlin", ".go": "Go",
    ".rs": "Rust", ".cpp": "C/C++", ".cc": "C/C++", ".c": "C/C++", ".hpp": "C/C++", ".h": "C/C++", ".cs": "C#", ".swift": "Swift", ".php": "PHP", ".rb": "Ruby",
}
IMPORTANT_SUBDIRS = ("models", "routes", "controllers", "services", "views", "tests")
KNOWN_CONFIG_FILES = ("package.json", "requirements.txt", "pyproject.toml", "Dockerfile", "docker-compose.yml", "Cargo.toml", "pom.xml", "build.gradle", "composer.json", "angular.json", "vite.config.ts", "vite.config.js", "next.config.js", "tailwind.config.js", "README.md", "LICENSE")
PYTHON_PACKAGES = {
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "streamlit": "Streamlit", "langchain": "LangChain", "llama-index": "LlamaIndex",
    "pydantic": "Pydantic", "sqlalchemy": "SQLAlchemy", "pytest": "PyTest", "numpy": "NumPy", "pandas": "Pandas", "torch": "PyTorch", "tensorflow": "TensorFlow",
}
JS_PACKAGES = {
    "react": "React", "next": "Next.js", "express": "Express", "vue": "Vue", "@angular/core": "Angular", "vite": "Vite", "tailwindcss": "Tailwind CSS",
    "electron": "Electron", "@nestjs/core": "NestJS", "svelte": "Svelte", "nuxt": "Nuxt",
}
PYPROJECT_TOOLS = {"ruff": "Ruff", "black": "Black", "mypy": "MyPy"}
CONTAINER_FILES = {"Dockerfile": "Docker", "docker-compose.yml": "Docker Compose", "compose.yml": "Docker Compose"}
TIME_ZONES = {"GMT": "+00:00", "UTC": "+00:00", "IST": "+05:30"}
SYMBOL_PRIORITY = {"class": 0, "function": 1, "variable": 2}
# End of the fixed values.

MIN_ROOT_SCORE = 30


@dataclass(frozen=True)
class Rules:
    """All rule sets of a scan; replace a field to change a rule."""

    scan_ignore_dirs: tuple[str, ...] = SCAN_IGNORE_DIRS
    scan_ignore_files: tuple[str, ...] = SCAN_IGNORE_FILES
    supported_extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS
    extension_language: dict[str, str] = field(default_factory=lambda: dict(EXTENSION_LANGUAGE))
    root_ignore_dirs: tuple[str, ...] = ROOT_IGNORE_DIRS
    common_source_names: tuple[str, ...] = COMMON_SOURCE_NAMES
    project_files: tuple[str, ...] = PROJECT_FILES
    root_language: dict[str, str] = field(default_factory=lambda: dict(ROOT_LANGUAGE))
    important_subdirs: tuple[str, ...] = IMPORTANT_SUBDIRS
    known_config_files: tuple[str, ...] = KNOWN_CONFIG_FILES
    python_packages: dict[str, str] = field(default_factory=lambda: dict(PYTHON_PACKAGES))
    js_packages: dict[str, str] = field(default_factory=lambda: dict(JS_PACKAGES))
    min_root_score: int = MIN_ROOT_SCORE


DEFAULT = Rules()


def pairs(spark: SparkSession, values: dict[str, str], key: str, value: str) -> DataFrame:
    """A rule table of literal rows: a handful, whatever the data, so that it may be broadcast."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in values.items())
    return spark.sql(f"SELECT * FROM VALUES {rows or "('', '')"} AS t({key}, {value})").where(f"{key} <> ''")
