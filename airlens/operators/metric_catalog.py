"""Metric families in rendering order.

Fixed values: numbers, names, kinds, help texts and label names of the exposition. Columns: id | name | kind | label | help.
A label "input+reason" is a composite of two. The name prefix is a parameter of the renderer.
"""

from __future__ import annotations

FAMILIES = """
1|headend_info|info|version|toolkit build info
2|metrics_snapshots_dropped_total|counter||snapshots this exporter failed to send
3|errors_total|counter|reason|network errors by reason
10|output_packets_total|counter||packets sent on the output
11|output_bytes_total|counter||bytes sent on the output
12|output_errors_total|counter||output send errors
13|configured_services|gauge||services configured
14|active_services|gauge||services currently active
20|input_up|gauge|input|1 if the input is currently connected
21|input_bytes_total|counter|input|bytes read from the input
22|input_reconnects_total|counter|input|input reconnect count
23|input_errors_total|counter|input+reason|input errors by reason
24|input_last_data_time_seconds|gauge|input|unix time of the last data received
30|ts_packets_total|counter||transport stream packets processed
31|ts_continuity_errors_total|counter||continuity counter errors
32|ts_discontinuities_total|counter||signaled discontinuities
33|ts_sync_errors_total|counter||TS sync byte errors
34|pcr_discontinuities_total|counter||implausible PCR jumps
40|psi_sections_total|counter|table|PSI/SI sections generated by table
41|psi_errors_total|counter|table|PSI/SI section build errors by table
50|cas_ecmg_connected|gauge|cas|1 if connected to the ECMG
51|cas_emmg_clients|gauge|cas|connected EMMG clients
52|cas_cryptoperiod_transitions_total|counter|cas|cryptoperiod transitions
53|cas_ecm_total|counter|cas|ECMs generated
54|cas_ecm_errors_total|counter|cas|ECM generation errors
55|cas_emm_total|counter|cas|EMMs published
58|cas_emm_dropped_total|counter|cas|EMMs dropped, oversized or send queue full
56|cas_scrambled_packets_total|counter||packets scrambled
57|cas_unexpected_clear_packets_total|counter||clear packets on a managed pid before the ECMG was up
60|radio_audio_frames_total|counter|codec|audio frames processed by codec
61|radio_audio_framing_errors_total|counter||audio framing/parse errors
62|radio_metadata_updates_total|counter||metadata updates parsed
63|radio_metadata_errors_total|counter||metadata parse errors
70|tv_source_program_up|gauge||1 if the program has at least one active service
71|tv_source_pmt_updates_total|counter||PMT content changes seen
72|tv_source_pid_changes_total|counter||elementary stream pid changes seen
73|tv_remux_packets_total|counter||packets passed through the remux
74|tv_remux_dropped_packets_total|counter||packets dropped by the remux
75|tv_ait_sections_total|counter||AIT sections sent
76|tv_ait_errors_total|counter||AIT build errors
77|tv_eit_queue_drops_total|counter||EIT sections discarded, reassembly queue full
80|sds_service_providers|gauge||service providers announced
81|sds_services|gauge||services announced
82|sds_documents_generated_total|counter||SD&S documents (re)generated
83|sds_document_errors_total|counter||SD&S document generation errors
84|sds_announcements_total|counter|transport|announcement cycles sent by transport
85|sds_announcement_errors_total|counter||announcement send errors
86|sds_last_success_time_seconds|gauge||unix time of the last successful announcement
90|bcg_sources_configured|gauge||guide sources configured
91|bcg_sources_up|gauge||guide sources currently loaded
92|bcg_source_errors_total|counter|reason|guide source load/parse errors by reason
93|bcg_services|gauge||channels in the loaded guide
94|bcg_services_with_events|gauge||channels with an event in the current window
95|bcg_events|gauge||events in the current window
96|bcg_documents_generated_total|counter||BCG documents generated
97|bcg_document_errors_total|counter||BCG document generation errors
98|bcg_publications_total|counter||BCG documents published
99|bcg_publication_errors_total|counter||BCG publication send errors
100|bcg_last_success_time_seconds|gauge||unix time of the last successful publication
101|bcg_schedule_start_time_seconds|gauge||earliest event start in the current window
102|bcg_schedule_end_time_seconds|gauge||latest event end in the current window
110|rist_sender_sent_total|counter|peer|packets sent to this RIST peer
111|rist_sender_retransmitted_total|counter|peer|packets retransmitted to this RIST peer
112|rist_sender_rtt_milliseconds|gauge|peer|current RTT to this RIST peer
120|rist_receiver_received_total|counter||packets received on the RIST flow
121|rist_receiver_missing_total|counter||packets missing on the RIST flow, incl reordered
122|rist_receiver_recovered_total|counter||packets recovered via retransmit
123|rist_receiver_lost_total|counter||packets never recovered
124|rist_receiver_rtt_milliseconds|gauge||average RTT across the flow's peers
125|rist_receiver_buffer_milliseconds|gauge||current recovery buffer fill
130|rec_bytes_total|counter||bytes written across all outputs
131|rec_output_up|gauge|output|1 if this output's last write succeeded
132|rec_output_errors_total|counter|output|output write failures
133|rec_elapsed_seconds|gauge||seconds since recording started
134|rec_duration_limit_seconds|gauge||configured recording duration, 0 if unlimited
140|descramble_mode|info|mode|detected CAS scheme
141|descramble_key_load_errors_total|counter||RSA/device key load failures
142|descramble_output_errors_total|counter||output emit failures
150|cam_connections_active|gauge||connected cs378x clients
151|cam_connections_total|counter||cs378x client connections accepted
152|cam_auth_errors_total|counter|reason|cs378x auth/protocol errors by reason
153|cam_services_active|gauge||services with a live session key
160|fcc_channels_active|gauge||channels currently tracked
161|fcc_bursts_active|gauge||concurrent FCC burst sessions
162|fcc_ret_clients_active|gauge||active unicast RET sessions
163|fcc_bytes_retransmitted_total|counter||bytes retransmitted via FCC bursts
164|fcc_nacks_total|counter||NACKs handled
165|fcc_congestion_adaptations_total|counter||burst rate reduced due to congestion
"""


def rows() -> list[tuple[int, int, str, str, str, str]]:
    """(def_ord, id, name, kind, label, help) per family."""
    lines = [line.split("|") for line in FAMILIES.strip().splitlines()]
    return [(i, int(n), name, kind, label, text) for i, (n, name, kind, label, text) in enumerate(lines)]
