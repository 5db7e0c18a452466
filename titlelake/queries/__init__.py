"""Query registrations (see ``titlelake.catalog``)."""
