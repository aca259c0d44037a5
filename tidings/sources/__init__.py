"""Where campaign messages and favourites come from."""

from tidings.sources.campaigns import campaign_stream, file_campaign_stream
from tidings.sources.tables import Favourites, favourites

__all__ = ["Favourites", "campaign_stream", "favourites", "file_campaign_stream"]
