"""File paths: language, what belongs into an index, ignore files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift",
    "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "vue": "vue",
    "svelte": "svelte", "prisma": "prisma", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml",
    "md": "markdown", "mdx": "markdown", "sh": "shell", "bash": "shell", "zsh": "shell", "dart": "dart",
}
EXCLUDED_DIRS = [
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", ".next", ".nuxt", ".output", "coverage",
    "__pycache__", ".pytest_cache", ".mypy_cache", "venv", ".venv", "env", ".env", "vendor", "target", "Pods",
    ".gradle", ".idea", ".vscode", ".DS_Store", "tmp", "temp", "logs", "log", ".cache", ".parcel-cache", ".turbo",
    "storybook-static",
]
EXCLUDED_PATTERNS = [
    r"\.min\.(js|css)$", r"\.bundle\.(js|css)$", r"\.map$", r"\.lock$", r"package-lock\.json$", r"yarn\.lock$",
    r"pnpm-lock\.yaml$", r"composer\.lock$", r"Gemfile\.lock$", r"Cargo\.lock$", r"\.d\.ts$", r"\.generated\.",
    r"\.snap$",
]
BINARY = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "avif", "woff", "woff2", "ttf", "otf", "eot", "pdf",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "tar", "gz", "rar", "7z", "bz2", "mp3", "mp4", "wav", "ogg",
    "webm", "avi", "mov", "flv", "exe", "dll", "so", "dylib", "class", "pyc", "pyo", "o", "obj", "db", "sqlite",
    "sqlite3", "bin", "dat", "dump",
]
PRIORITY_FOLDERS = [
    "src", "lib", "app", "pages", "components", "api", "server", "client", "core", "modules", "packages", "services",
    "utils", "helpers", "hooks", "contexts", "providers", "middleware", "routes", "controllers", "models", "schemas",
    "types", "interfaces", "config", "scripts",
]
IMPORTANT_FILES = [
    "package.json", "tsconfig.json", "schema.prisma", ".env.example", "README.md", "Dockerfile", "docker-compose.yml",
    "docker-compose.yaml",
]
LARGE_LINES, CHARS_PER_LINE = 50_000, 40
# Fixed value: kilobytes beyond which a repository is warned of.
LARGE_KB = 50_000


def extension(path: Column) -> Column:
    """What follows the last dot, lower-cased; without a dot, the whole path."""
    return F.lower(F.substring_index(path, ".", -1))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("text"))


def is_code(path: Column) -> Column:
    return language(path) != "text"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def in_excluded_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), _strings(EXCLUDED_DIRS))


def is_excluded(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in EXCLUDED_PATTERNS))


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY)


def in_priority_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), _strings(PRIORITY_FOLDERS))


def is_important(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(IMPORTANT_FILES)


def ignore_rules(content: str) -> list[str]:
    """Lines of an ignore file, without blank ones and comments; negations are left out."""
    lines = [line.strip() for line in content.splitlines()]
    return [line for line in lines if line and line[0] not in "#!"]


def ignore_regex(rule: str) -> str | None:
    """The regular expression of an ignore rule; null for one that gives none.

    A rule with a leading slash holds from the root, any other from any folder; a trailing slash stands for all that
    is in the folder; ** crosses folders, * and ? don't.
    """
    rooted, folder = rule.startswith("/"), rule.endswith("/")
    out = ""
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", rule.strip("/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.escape(piece)
    if not out:
        return None
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:$|/)")


def is_ignored(path: Column, rules: list[str]) -> Column:
    found = [r for r in map(ignore_regex, rules) if r]
    return path.rlike("|".join(found)) if found else F.lit(False)


def is_included(path: Column, rules: list[str] = ()) -> Column:
    """Code that is neither binary, nor in an excluded folder, nor of an excluded pattern, nor ignored."""
    return ~is_binary(path) & ~in_excluded_dir(path) & ~is_excluded(path) & ~is_ignored(path, list(rules)) & is_code(path)


def lines_of(size: Column) -> Column:
    """Estimated lines of a file of so many bytes."""
    return F.ceil(size / F.lit(float(CHARS_PER_LINE))).cast("long")


def size_warning(kilobytes: Column) -> Column:
    """(exceeds, kilobytes, threshold) of a repository's size."""
    return F.struct((kilobytes > LARGE_KB).alias("exceeds"), kilobytes.alias("kilobytes"), F.lit(LARGE_KB).cast("long").alias("threshold"))
