from .catalog import read_catalog, write_catalog
from .payload import write_payload
from .raw import read_raw

__all__ = ["read_catalog", "read_raw", "write_catalog", "write_payload"]
