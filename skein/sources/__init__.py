from skein.sources.tables import table

__all__ = ["table"]
