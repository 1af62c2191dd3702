from .ingest import run_available, stream_files

__all__ = ["run_available", "stream_files"]
