"""All plans; importing this module registers every query."""

from meridia.plans import agreement, audits, buildings, evidence, files, identity, ledgers, logs, measure, models, network, objectives, policy, radio, rays, reflection, search, shapes, studies, transmitters  # noqa: F401
from meridia.plans.registry import ORACLE, QUERIES  # noqa: F401
