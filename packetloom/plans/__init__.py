"""Plans that combine operators, and the named queries."""


def load_queries() -> None:
    """Import the query modules, which register themselves."""
    from packetloom.plans import (document_queries, image_queries, payload_queries, rule_queries,  # noqa: F401
                                  telemetry_queries, text_queries, verdict_queries)
    from packetloom.plans import streaming_queries  # noqa: F401
