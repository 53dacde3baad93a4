"""Traversal plans and their rewriting before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Caps and the edge kinds that an intent asks for.
DEPTH_CAP, NODE_CAP, TOKENS_PER_NODE = 8, 5000, 150
INTENTS = {
    "impact": ("CALLS", "DEPENDS_ON", "IMPORTS_FROM"),
    "callers": ("CALLS",),
    "imports": ("IMPORTS_FROM",),
    "inheritance": ("IMPLEMENTS", "INHERITS"),
    "tests": ("TESTED_BY",),
}


@dataclass(frozen=True)
class TraversalPlan:
    """direction: outbound, inbound or bidirectional. edge_kinds and node_kinds: None for all; node_kinds only limits what is returned."""

    max_depth: int = 5
    max_nodes: int = 10_000
    direction: str = "outbound"
    edge_kinds: tuple[str, ...] | None = None
    node_kinds: tuple[str, ...] | None = None


def optimize(plan: TraversalPlan, token_budget: int | None = None, intent: str | None = None, tokens_per_node: int = TOKENS_PER_NODE) -> TraversalPlan:
    """Depth cap, then the nodes a token budget has room for, then the intent's edge kinds (added to given ones), then the node cap."""
    plan = replace(plan, max_depth=min(plan.max_depth, DEPTH_CAP))
    if token_budget is not None:
        plan = replace(plan, max_nodes=min(plan.max_nodes, token_budget // max(tokens_per_node, 1)))
    if intent in INTENTS:
        plan = replace(plan, edge_kinds=tuple(sorted({*INTENTS[intent], *(plan.edge_kinds or ())})))
    return replace(plan, max_nodes=min(plan.max_nodes, NODE_CAP))
