"""Query compiler, paging, export."""
