from deltaview.functions import catalog, windows
from deltaview.functions.interest import Interest

__all__ = ["Interest", "catalog", "windows"]
