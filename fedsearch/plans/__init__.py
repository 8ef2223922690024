"""Query catalogue: fixture views, registered queries and their SQL oracles."""


def load_catalogue():
    """Import every catalogue module so its queries register themselves."""
    from fedsearch.plans import (q_answers, q_chain, q_features, q_files, q_ir, q_pool, q_retrieval,  # noqa: F401
                                 q_hooks, q_learned, q_router, q_stream, q_text, q_workflow)
    from fedsearch.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
