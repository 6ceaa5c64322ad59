"""Column -> Column functions (JVM-side expressions only)."""
from tessera.functions.text import *  # noqa: F401,F403
from tessera.functions.decode import decode_text  # noqa: F401
