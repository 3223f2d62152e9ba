"""Channels of the tests: they note what was sent in a folder, and fail or die on demand."""

import os

from regdelta.sources.channels import ChannelError


def email(row):
    if row.subject == "refused":
        raise ChannelError("mailbox full")
    with open(f"{row.body}/{row.alert_id}", "a") as f:
        f.write("x")
    if row.subject == "dies" and not os.path.exists(f"{row.body}/died"):
        open(f"{row.body}/died", "w").close()
        os._exit(1)


SENDERS = {"email": email}
