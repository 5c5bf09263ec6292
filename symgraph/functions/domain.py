"""Labels, word lists and weights of the graph's domain."""

from __future__ import annotations

# Node kinds.
NODE_KINDS = ("class", "constant", "field", "file", "function", "import", "method", "module", "parameter", "property", "variable", "model", "route", "template", "view", "selector", "external")
# Edge kinds.
EDGE_KINDS = (
    "calls", "contains", "decorates", "extends", "imports", "instantiates", "overrides", "references", "returns", "type_of", "extends_template", "handles",
    "includes_template", "receives", "relates_to", "renders", "resolves", "routes_to", "styles", "admin_of", "overrides_template", "tests", "reads",
    "accesses_member", "context_type", "loop_binding", "reverse_accessor", "derived_collection", "uses_tag",
)
# Language labels.
NODE_LANGUAGES = ("python", "htmldjango", "javascript", "css")
# Kinds that define behaviour.
DEFINITION_KINDS = ("function", "method", "class", "model", "view", "route")
# Kinds whose incoming edges carry the impact of a change onward.
REACH_KINDS = ("calls", "decorates", "extends", "extends_template", "handles", "imports", "includes_template", "instantiates", "overrides", "overrides_template", "receives", "references", "renders", "resolves", "routes_to")
# Kinds that a flow follows.
FLOW_KINDS = ("calls", "extends_template", "handles", "includes_template", "instantiates", "receives", "renders", "resolves", "routes_to")
# Kinds that a path between two symbols may take besides those of a flow.
PATH_KINDS = (*FLOW_KINDS, "decorates", "extends", "overrides", "references")
# Kinds of a pending reference that later passes bind, not the resolver.
PIPELINE_KINDS = ("accesses_member", "context_type", "derived_collection", "loop_binding", "reverse_accessor")
# Name fragments that mark a symbol as security sensitive.
SECURITY_WORDS = (
    "auth", "billing", "credential", "csrf", "decrypt", "encrypt", "escape", "invoice", "login", "logout", "passwd", "password", "payment", "permission", "pickle",
    "raw_sql", "sanitize", "secret", "session", "signature", "subprocess", "superuser", "token",
)
# Names that the framework calls, and class suffixes that it finds by convention.
HOOK_NAMES = ("clean", "delete", "get_absolute_url", "handle", "Meta", "ready", "save")
FRAMEWORK_SUFFIXES = ("Admin", "Config", "Migration")
# Field constructors that declare a relation.
RELATION_FIELDS = ("ForeignKey", "ManyToManyField", "OneToOneField", "GenericRelation")
# Query words without a ranking signal.
STOP_WORDS = (
    "add", "all", "also", "and", "any", "are", "back", "been", "being", "but", "can", "could", "did", "does", "for", "from", "get", "gets", "got", "has",
    "have", "how", "into", "its", "make", "new", "nor", "not", "onto", "set", "should", "that", "the", "these", "this", "those", "use", "used", "uses", "via",
    "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "yet",
)
# Queryset methods that are never bound by name.
QUERYSET_BUILTINS = (
    "aggregate", "all", "annotate", "bulk_create", "bulk_update", "contains", "count", "create", "defer", "delete", "difference", "distinct", "earliest", "exclude",
    "exists", "filter", "first", "get", "get_or_create", "in_bulk", "intersection", "iterator", "last", "latest", "none", "only", "order_by", "prefetch_related",
    "raw", "reverse", "select_related", "union", "update", "update_or_create", "using", "values", "values_list",
)
# The kinds a reference of a kind prefers as its target; "" for all others.
PREFERRED_KINDS = {
    "calls": ("function", "method"),
    "extends": ("class", "model"),
    "instantiates": ("class", "model"),
    "decorates": ("function", "method", "class"),
    "returns": ("class", "model"),
    "type_of": ("class", "model"),
    "relates_to": ("model", "class"),
    "receives": ("model", "class"),
    "admin_of": ("model", "class"),
    "renders": ("template",),
    "extends_template": ("template",),
    "includes_template": ("template",),
    "styles": ("selector",),
    "resolves": ("route",),
    "handles": ("function", "method"),
    "routes_to": ("view", "function", "method", "class"),
    "tests": ("class", "model", "function", "view"),
    "reads": ("constant", "variable"),
    "uses_tag": ("function", "method"),
    "": ("class", "function", "method", "model", "variable", "view"),
}
# Kinds of reference that bind to a preferred kind or not at all.
STRICT_KINDS = ("relates_to", "receives", "returns", "type_of", "extends", "instantiates", "renders", "extends_template", "includes_template", "styles", "resolves", "admin_of", "tests", "reads", "uses_tag")
# Kinds that a loose match may not bind to.
LOOSE_BARRED = ("field", "property", "variable", "constant", "parameter", "import")
# Kinds that other projects may link to.
LINKABLE_KINDS = ("class", "constant", "file", "function", "method", "model", "variable", "view")

# Weight of each entry kind of a flow.
ENTRY_WEIGHTS = {
    "route": 1.0, "drf_view": 1.0, "celery_task": 0.6, "management_command": 0.6, "signal_receiver": 0.6, "admin_action": 0.4, "app_config_hook": 0.3,
    "model_lifecycle": 0.3, "true_root": 0.3,
}
# Weights of a flow's criticality (they sum to one) and the counts at which each saturates.
CRITICALITY = {"entry": 0.20, "apps": 0.20, "security": 0.20, "test_gap": 0.15, "projects": 0.10, "external": 0.10, "depth": 0.05}
CRITICALITY_SATURATION = {"apps": 5, "projects": 2, "external": 5, "depth": 15}
FLOW_DEPTH = 15
FLOW_NODES = 2000
# Decorator and base-class fragments of entry kinds.
DRF_DECORATORS = ("api_view", "renderer_classes", "permission_classes")
DRF_BASES = ("APIView", "GenericAPIView", "ViewSet")
TASK_DECORATORS = ("periodic_task", "shared_task", "task")
RECEIVER_DECORATORS = ("receiver",)

# Weights of the review risk (they sum to one) and the measures at which each saturates.
RISK = {"callers": 0.05, "churn": 0.10, "cross_app": 0.07, "cross_project": 0.08, "diff": 0.05, "flow": 0.25, "security": 0.15, "test_gap": 0.25}
RISK_SATURATION = {"callers": 20, "churn": 10, "cross_app": 5, "cross_project": 2, "diff": 100, "flow": 2.0, "tests": 5}
CHURN_DAYS = 90

# Restart walk, 20 rounds at damping 0.85.
WALK_ROUNDS = 20
WALK_DAMPING = 0.85
# BM25.
BM25_K1 = 1.2
BM25_B = 0.75
# Recency of a file: half-life in the exponent per day, window in days, weights.
RECENCY_DECAY = 0.231
RECENCY_DAYS = 7
RECENCY_WEIGHTS = {"dirty": 0.5, "session": 0.3, "commit": 0.2}
RECENCY_BONUS = 0.25
