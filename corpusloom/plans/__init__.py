"""Query registry; importing ``registry`` users below fills it."""
