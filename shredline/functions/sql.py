"""SQL surface (UDF-01): the vault decrypt as a SQL function.

Registered as a Spark SQL function whose body is a plain SQL expression
(``try_aes_decrypt`` …), so SQL users get the same native, code-generated
path as the DataFrame API; keys still arrive as a column (joined in).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DECRYPT_VALUE = """
CREATE OR REPLACE TEMPORARY FUNCTION decrypt_value(bundle STRING, user_id STRING, dek BINARY)
RETURNS STRING
RETURN CASE
  WHEN bundle IS NULL OR bundle = '' OR user_id IS NULL OR dek IS NULL OR length(dek) <> 32 THEN NULL
  WHEN size(split(bundle, ':', 3)) < 3 THEN NULL
  WHEN length(split(bundle, ':', 3)[0]) = 0 OR length(split(bundle, ':', 3)[1]) = 0
       OR length(split(bundle, ':', 3)[2]) = 0 THEN NULL
  ELSE CAST(try_aes_decrypt(
         concat(try_to_binary(split(bundle, ':', 3)[1], 'base64'), try_to_binary(split(bundle, ':', 3)[2], 'base64')),
         dek, 'GCM', 'DEFAULT', encode(user_id, 'UTF-8')) AS STRING)
END
"""

BUNDLE_KEY_ID = """
CREATE OR REPLACE TEMPORARY FUNCTION bundle_key_id(bundle STRING)
RETURNS STRING
RETURN CASE WHEN size(split(bundle, ':', 3)) >= 3 AND length(split(bundle, ':', 3)[0]) > 0
            THEN split(bundle, ':', 3)[0] END
"""


def register_functions(spark: SparkSession) -> list[str]:
    """Register the SQL functions in the session; returns their names."""
    spark.sql(DECRYPT_VALUE)
    spark.sql(BUNDLE_KEY_ID)
    return ["decrypt_value", "bundle_key_id"]
