"""All query modules; importing this fills the registry."""

from leafmill.plans import q_assembly, q_chapters, q_pdf, q_quality, q_reading, q_recovery, q_sources, q_store, q_text  # noqa: F401
from leafmill.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
