"""shredline: crypto-shredding, PII vault and privacy governance on Spark.

Every operator takes and returns DataFrames; the heavy lifting is native
Spark expressions (AES-GCM, SHA-2, JSON paths, higher-order functions) so
plans stay inside whole-stage code generation.
"""

from shredline.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
