from deltaview.sources import changelog, feeds

__all__ = ["changelog", "feeds"]
