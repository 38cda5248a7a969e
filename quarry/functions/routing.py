"""What a question asks for: its form, its subject, the strategy and the model that suit it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
# What makes a question code-like.
CODE_LIKE = [
    r"[{}()\[\]<>]",
    r"[=!<>]+",
    r"\b(function|class|const|let|var|def|fn|impl)\b",
    r"\w+\.\w+",
    r"\w+\([^)]*\)",
]
# Weights of vectors and words by form.
FORM_WEIGHTS = {"identifier": (0.4, 0.6), "code": (0.8, 0.2), "natural_language": (0.7, 0.3)}

# Keywords by subject, English then French, in order of preference.
SUBJECTS = {
    "API_ROUTES": ["endpoint", "endpoints", "api", "route", "routes", "rest", "http", "endpoint", "endpoints", "api", "route", "routes"],
    "COMPONENTS": ["component", "components", "ui", "widget", "widgets", "composant", "composants", "interface"],
    "HOOKS": ["hook", "hooks", "usehook", "custom hook", "hook", "hooks"],
    "SCHEMA": [
        "schema", "database", "db", "prisma", "model", "models", "table", "tables",
        "schema", "base de donnees", "modele", "modeles", "table", "tables",
    ],
    "TESTS": ["test", "tests", "testing", "spec", "specs", "unit test", "integration test", "test", "tests", "tester"],
    "TYPES": ["type", "types", "interface", "interfaces", "typedef", "typing", "type", "types", "interface", "interfaces", "typage"],
    "CONFIG": [
        "config", "configuration", "settings", "env", "environment", "stack", "tech stack", "technology", "technologies",
        "framework", "frameworks", "dependencies", "package", "packages", "library", "libraries", "font", "fonts",
        "typography", "typeface", "color", "colors", "theme", "tailwind", "css", "style", "styles", "design", "layout",
        "config", "configuration", "parametres", "environnement", "stack", "technique", "technologie", "technologies",
        "framework", "frameworks", "dependances", "librairie", "librairies", "bibliotheque", "bibliotheques", "police",
        "polices", "typographie", "typo", "typos", "couleur", "couleurs", "theme", "tailwind", "css", "style", "styles",
        "design", "layout", "mise en page",
    ],
    "EMBEDDINGS": [
        "embedding", "embeddings", "vector", "vectors", "vectorization", "voyage", "pgvector", "pinecone", "rag",
        "retrieval", "similarity", "semantic search", "chunk", "chunks",
        "embedding", "embeddings", "vecteur", "vecteurs", "vectorisation", "voyage", "pgvector", "pinecone", "rag",
        "retrieval", "similarite", "recherche semantique", "chunk", "chunks", "stockage",
    ],
    "INDEXING": [
        "index", "indexing", "reindex", "reindexing", "re-index", "pipeline", "parsing", "chunking", "contextual",
        "devstral", "mistral", "context generation", "webhook", "trigger", "github webhook",
        "index", "indexation", "reindexation", "re-indexation", "reindexer", "pipeline", "parsing", "chunking",
        "contextuel", "devstral", "mistral", "generation de contexte", "webhook", "declencheur", "trigger",
    ],
}
# What asks for a list.
LIST_WORDS = [
    "all", "list", "every", "available", "what are", "show me", "give me", "what is the", "tous", "toutes", "liste",
    "quels", "quelles", "disponibles", "montre", "donne", "c'est quoi", "quelle est", "quel est", "quoi",
]
# Fixed values: (path patterns, chunk types, symbol pattern) looked for by subject.
PRESETS = {
    "API_ROUTES": (["%route.ts", "%route.tsx", "%/api/%"], [], None),
    "COMPONENTS": (["%components%", "%.tsx"], ["function", "class"], None),
    "HOOKS": (["%hooks%", "%use%.ts", "%use%.tsx"], [], "use%"),
    "SCHEMA": (["%schema.prisma", "%prisma%", "%models%", "%entities%"], [], None),
    "TESTS": (["%.test.%", "%.spec.%", "%__tests__%"], [], None),
    "TYPES": (["%types%", "%.d.ts"], ["interface", "type"], None),
    "CONFIG": (
        ["%config%", "%.config.%", "%next.config%", "%tsconfig%", "%package.json", "%.env%", "%Dockerfile%", "%docker-compose%",
         "%.nvmrc", "%.node-version", "%layout.tsx", "%globals.css", "%tailwind%", "%theme%"], [], None,
    ),
    "EMBEDDINGS": (["%embeddings%", "%voyage%", "%vector%", "%rag%", "%lib/db%", "%reranker%", "%retrieval%"], [], None),
    "INDEXING": (["%indexing%", "%pipeline%", "%parsing%", "%chunker%", "%contextual%", "%ast-%"], [], None),
}

# Fixed values of the model router.
CODE_TASKS = [
    r"^write (a |an |the |some )?(new )?(function|class|method|component|service|module|script|code)",
    r"^add (a |an |the |some )?(new )?(function|method|class|component)",
    r"^create (a |an |the |some )?(new )?(function|class|component|service|module|type|interface)",
    r"^implement (a |an |the |some )?",
    r"^generate (a |an |the |some )?(new )?",
    r"^build (a |an |the |some )?(new )?",
]
# Fixed values of the model router, as are those that follow.
COMPLEX_WORDS = [
    "implement", "create", "build", "design", "architect", "refactor", "optimize", "debug", "fix", "why", "compare", "analyze",
    "review", "improve", "migrate", "convert", "suggest", "recommend", "best practice", "how should", "help me",
]
SIMPLE_WORDS = [
    "what is", "what's", "where is", "where's", "who is", "who's", "how many", "list", "show me", "find", "get", "return",
    "define", "explain briefly",
]


def form(question: Column) -> Column:
    """identifier, code or natural_language."""
    t = trimmed(question)
    like = reduce(lambda a, b: a | b, [t.rlike(p) for p in CODE_LIKE])
    return F.when(t.rlike(IDENTIFIER), "identifier").when(like, "code").otherwise("natural_language")


def subject_scores(question: Column) -> Column:
    """[(type, score)] in order of preference; score: length of all contained keywords, those given twice count twice."""
    low = trimmed(F.lower(question))
    return F.array(
        *[
            F.struct(F.lit(name).alias("type"), reduce(lambda a, b: a + b, [F.when(low.contains(k), len(k)).otherwise(0) for k in keys]).alias("score"))
            for name, keys in SUBJECTS.items()
        ]
    )


def classified(scores: Column, question: Column) -> Column:
    """(type, is_list, confidence): the subject of the highest score above 0, the first on a tie, else GENERIC."""
    start = F.struct(F.lit("GENERIC").alias("type"), F.lit(0).alias("score"))
    best = F.aggregate(scores, start, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    low = trimmed(F.lower(question))
    is_list = reduce(lambda a, b: a | b, [low.contains(w) for w in LIST_WORDS])
    return F.struct(best["type"].alias("type"), is_list.alias("is_list"), F.least(best["score"] / F.lit(20.0), F.lit(1.0)).alias("confidence"))


def expanded_words(question: Column) -> Column:
    """The fall-back expansion: words of more than three characters."""
    return F.filter(F.split(question, r"[ \t\n\r]+"), lambda w: F.length(w) > 3)


def path_patterns(patterns: Column, architecture: Column) -> Column:
    """Patterns set between %; infrastructure folders come with questions of architecture."""
    more = F.array(*[F.lit(x) for x in ("%lib/%", "%api/%", "%services/%", "%config%")])
    given = F.transform(patterns, lambda p: F.concat(F.lit("%"), p, F.lit("%")))
    return F.array_distinct(F.concat(given, F.when(architecture, more).otherwise(F.array().cast("array<string>"))))


def search_words(keywords: Column, concepts: Column) -> Column:
    """What an expanded question searches for: keywords, then concepts."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(keywords, none), F.coalesce(concepts, none)), " ")


def strategy(question: Column, subject_: Column, patterns: Column | None = None, hybrid_v2: bool = True, forced: Column | None = None) -> Column:
    """forced, else symbol for one identifier, expanded with patterns of an expansion, metadata for a list of a known
    subject, hybrid_v2 if it is on, hybrid for a known subject, else vector."""
    known = subject_["type"] != "GENERIC"
    n = F.size(patterns) if patterns is not None else F.lit(0)
    out = (
        F.when(trimmed(question).rlike(IDENTIFIER), "symbol")
        .when((~known | (subject_["confidence"] < 0.3)) & (n > 0), "expanded")
        .when(known & subject_["is_list"] & (subject_["confidence"] >= 0.3), "metadata")
    )
    out = out.otherwise("hybrid_v2") if hybrid_v2 else out.when(known, "hybrid").otherwise("vector")
    return out if forced is None else F.coalesce(forced, out)


def model(question: Column, context_tokens: Column | None = None, threshold: int = 5000) -> Column:
    """(complexity, model, confidence) for a question; a large context needs the larger model."""
    low = trimmed(F.lower(question))
    n = F.size(F.split(question, r"[ \t\n\r]+"))
    simple = "|".join(re.escape(w) for w in SIMPLE_WORDS)
    case = (
        F.when(question.rlike("(?i)" + "|".join(CODE_TASKS)), 1)
        .when(low.rlike("|".join(re.escape(w) for w in COMPLEX_WORDS)), 2)
        .when((n < 20) & low.rlike(f"^(?:{simple})| (?:{simple})"), 3)
        .when(n < 8, 4)
        .when(n > 50, 5)
        .otherwise(6)
    )
    of = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), case)
    complexity = of("complex", "complex", "simple", "simple", "complex", "moderate")
    chosen = of("chat", "chat", "haiku", "haiku", "chat", "chat")
    sure = of(0.9, 0.85, 0.8, 0.7, 0.75, 0.6)
    if context_tokens is None:
        return F.struct(complexity.alias("complexity"), chosen.alias("model"), sure.alias("confidence"))
    more = (context_tokens > threshold) & (chosen == "haiku")
    return F.struct(
        complexity.alias("complexity"), F.when(more, "chat").otherwise(chosen).alias("model"), F.when(more, sure * 0.9).otherwise(sure).alias("confidence")
    )
