"""Writers of the domain's text formats."""
