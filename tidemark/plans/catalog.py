"""All registered queries. Importing a section registers its queries."""

from tidemark.plans import (q_draws, q_features, q_fit, q_lifecycle, q_planning, q_profile, q_quality, q_response,  # noqa: F401
                            q_transforms, q_weekly)
from tidemark.plans.registry import QUERIES, TWINS


def queries():
    return dict(QUERIES)


def twins():
    return dict(TWINS)
